"""Registered queries: each operator applied to the test tables, with its SQL counterpart."""

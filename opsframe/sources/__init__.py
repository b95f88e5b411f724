"""Readers of landed telemetry and writers of produced tables."""

"""Equality, range and set rules shared by the scorers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_match(pred: Column, target: Column) -> Column:
    """Ordered equality of two arrays; wrap a scalar in ``F.array`` first, so ``x`` equals ``[x]``."""
    return pred.eqNullSafe(target)


def strip(text: Column) -> Column:
    """Without white space (of any kind) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def exact_match_ci(pred: Column, target: Column) -> Column:
    return F.lower(strip(pred)) == F.lower(strip(target))


def in_range(pred: Column, target: Column, tolerance: Column) -> Column:
    return pred.between(target - tolerance, target + tolerance)


def is_subset(pred: Column, target: Column) -> Column:
    return F.size(F.array_except(pred, target)) == 0


def is_superset(pred: Column, target: Column) -> Column:
    return is_subset(target, pred)

"""Fields of one span, read from its nested form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = "ROOT"
UNKNOWN = "Unknown"
RESPONSE_TAGS = ("http.status_code", "response_class")


def service_name(processes: Column, process_id: Column) -> Column:
    return F.try_element_at(processes, process_id)["serviceName"]


def parent_span(references: Column) -> Column:
    """First ``CHILD_OF`` reference, else ``ROOT``."""
    parents = F.filter(references, lambda r: r["refType"] == "CHILD_OF")
    return F.coalesce(F.try_element_at(parents, F.lit(1))["spanID"], F.lit(ROOT))


def _is_true(value: Column) -> Column:
    """Boolean true or the number 1, but never text (which prints with quotes)."""
    return F.coalesce(F.to_json(value).rlike(r"^(?:true|1(?:\.0+)?(?:E0)?)$"), F.lit(False))


def has_error(tags: Column) -> Column:
    return F.coalesce(
        F.exists(tags, lambda t: (t["key"] == "error") & _is_true(t["value"])), F.lit(False)
    )


def response(tags: Column) -> Column:
    """Last response tag as text, else ``Unknown``."""
    answers = F.filter(tags, lambda t: t["key"].isin(*RESPONSE_TAGS))
    last = F.try_element_at(answers, F.lit(-1))["value"]
    return F.coalesce(F.try_variant_get(last, "$", "string"), F.lit(UNKNOWN))

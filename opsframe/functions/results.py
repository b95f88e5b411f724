"""Results objects with declared keys as columns and everything else kept beside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The keys that evaluation writes, and the types of their values.
KEYS = {
    "Detection Accuracy": "string",
    "Localization Accuracy": "double",
    "success": "boolean",
    "is_subset": "boolean",
    "system_level_correct": "boolean",
    "fault_type_correct": "boolean",
    "TTD": "double",
    "TTL": "double",
    "TTA": "double",
    "TTM": "double",
    "steps": "bigint",
    "in_tokens": "bigint",
    "out_tokens": "bigint",
    "reasoning_score": "double",
    "reasoning_judgement": "string",
}
REST = "rest"
#: Kinds of JSON values that may become a column of a type; a number in quotes is no number.
_KINDS = {"string": ("STRING",), "boolean": ("BOOLEAN",), "double": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "bigint": ("BIGINT",)}


def column_name(key: str) -> str:
    return key.lower().replace(" ", "_")


def split_results(results: Column, keys: dict[str, str] | None = None) -> Column:
    """A struct of the declared keys as typed fields and ``rest``, a VARIANT object of all others.

    A declared key whose value has another type stays in ``rest`` and its field is null, so nothing
    is lost. A JSON null is a null field. A null, or a value that is no object, has null fields; the
    latter is ``rest`` as a whole. Row-local: no row is exploded.
    """
    keys = KEYS if keys is None else keys
    entries = F.from_json(F.to_json(results), "map<string, variant>")
    is_object = F.schema_of_variant(results).startswith("OBJECT")

    def held(value: Column, kind: str) -> Column:
        shape = F.schema_of_variant(value)
        fits = F.lit(False)
        for start in _KINDS[kind]:
            fits = fits | shape.startswith(start)
        return F.coalesce(fits, F.lit(False))

    def split(found: Column) -> Column:
        fields = []
        for key, kind in keys.items():
            value = found[key]
            fields.append(F.when(held(value, kind), F.try_variant_get(value, "$", kind)).alias(column_name(key)))
        others = F.map_filter(found, lambda key, value: ~_taken(key, value))
        return F.struct(*fields, F.parse_json(F.to_json(others)).alias(REST))

    def _taken(key: Column, value: Column) -> Column:
        out = F.lit(False)
        for name, kind in keys.items():
            out = out | ((key == name) & (held(value, kind) | F.is_variant_null(value)))
        return out

    none = F.struct(*(F.lit(None).cast(kind).alias(column_name(key)) for key, kind in keys.items()), results.alias(REST))
    return F.when(is_object, F.transform(F.array(entries), split)[0]).otherwise(none)

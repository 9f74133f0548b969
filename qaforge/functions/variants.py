"""Fields of JSON values whose shape isn't fixed, as Variant columns: a missing key, a JSON null, one value and a list differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """A JSON text as a Variant; null for a null text and for one that isn't JSON."""
    return F.try_parse_json(text)


def value(v: Column, path: str) -> Column:
    """The value at a path as a Variant: null (of SQL) where it is missing, a Variant null for a JSON null."""
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """missing, null, object, array, string, boolean or number."""
    schema = F.schema_of_variant(v)
    out = F.when(v.isNull(), "missing").when(F.is_variant_null(v), "null")
    for name, start in (("object", "OBJECT"), ("array", "ARRAY"), ("string", "STRING"), ("boolean", "BOOLEAN")):
        out = out.when(schema.startswith(start), name)
    return out.otherwise("number")


def field(v: Column, path: str, of: str, default: Column) -> Column:
    """The value at a path as the type `of`: the default only where the key is missing; null for a JSON null, for a list or an
    object, and for a value that isn't of the type."""
    found = value(v, path)
    one = ~kind(found).isin("object", "array")
    return F.when(found.isNull(), default).when(one, F.try_variant_get(v, path, of))


def items(v: Column) -> Column:
    """A list's items, or the one value as a list of one, as Variants.

    Missing, null, false, 0 and the empty string have no items; an empty list has none, either.
    """
    what = kind(v)
    nothing = what.isin("missing", "null") | (what == "boolean") & ~F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(False))
    nothing = nothing | (what == "number") & (F.coalesce(F.try_variant_get(v, "$", "double"), F.lit(0.0)) == 0) | (what == "string") & (F.try_variant_get(v, "$", "string") == "")
    return F.when(what == "array", F.try_variant_get(v, "$", "array<variant>")).when(nothing, F.array().cast("array<variant>")).otherwise(F.array(v))

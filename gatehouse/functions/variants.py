"""Type-strict access to JSON documents held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatehouse.functions.bind import let


def doc(json_text: Column) -> Column:
    return F.try_parse_json(json_text)


def at(v: Column, path: str) -> Column:
    """Sub-value, NULL when missing."""
    return F.try_variant_get(v, path, "variant")


def field(v: Column, name: str) -> Column:
    return at(v, "$['" + name.replace("'", "\\'") + "']")


def text(v: Column) -> Column:
    """JSON text: equality on it never mixes up true and "true"."""
    return F.to_json(v)


def items(v: Column) -> Column:
    """Array elements; empty for anything that is not an array."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def kind(v: Column) -> Column:
    """JSON type name of a value that is present."""
    return let(F.schema_of_variant(v), _kind_of_schema)


def _kind_of_schema(s: Column) -> Column:
    return (
        F.when(s == "VOID", "null").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean")
        .when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object")
        .when(s.isNotNull(), "number")
    )


def string(v: Column) -> Column:
    """The string value; NULL for other types."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def number(v: Column) -> Column:
    return F.when(kind(v) == "number", F.try_variant_get(v, "$", "double"))


def facts(v: Column) -> Column:
    """``struct<v, kind, num, str>`` of a value, each part read once."""
    return let(F.struct(v.alias("v"), kind(v).alias("kind")), lambda x: F.struct(
        x["v"].alias("v"), x["kind"].alias("kind"),
        F.when(x["kind"] == "number", F.try_variant_get(x["v"], "$", "double")).alias("num"),
        F.when(x["kind"] == "string", F.try_variant_get(x["v"], "$", "string")).alias("str")))


def keys(v: Column) -> Column:
    return F.coalesce(F.json_object_keys(F.when(kind(v) == "object", F.to_json(v))), F.array().cast("array<string>"))

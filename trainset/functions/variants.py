"""Typed access to VARIANT values (raw JSON of unknown shape)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def get(v: Column, *names: str) -> Column:
    """First *present* field among ``names``; a JSON null counts as present."""
    found = [F.try_variant_get(v, f"$.{n}", "variant") for n in names]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def fields(v: Column, *names: str) -> Column:
    """``struct<name: variant, …>`` of an OBJECT value in one reading; NULL for other values, as are absent fields.

    A path that leads nowhere costs Spark an exception, so rules that ask for many optional fields read them together.
    """
    return F.try_variant_get(v, "$", "struct<" + ",".join(f"`{n}`:variant" for n in names) + ">")


def first(x: Column, *names: str) -> Column:
    """Like :func:`get`, of the struct that :func:`fields` has read."""
    return x[names[0]] if len(names) == 1 else F.coalesce(*[x[n] for n in names])


def type_of(v: Column) -> Column:
    """STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID, ARRAY or OBJECT (NULL if absent)."""
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)


def has_type(v: Column, *names: str) -> Column:
    return F.coalesce(type_of(v).isin(*names), F.lit(False))


def is_string(v: Column) -> Column:
    return has_type(v, "STRING")


def is_object(v: Column) -> Column:
    return has_type(v, "OBJECT")


def is_array(v: Column) -> Column:
    return has_type(v, "ARRAY")


def is_integer(v: Column) -> Column:
    """Integers as Python sees them: booleans count, decimals do not."""
    return has_type(v, "BIGINT", "INT", "SMALLINT", "TINYINT", "BOOLEAN")


def is_number(v: Column) -> Column:
    return has_type(v, "BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT")


def absent(v: Column) -> Column:
    """Missing or JSON null."""
    return F.coalesce(has_type(v, "VOID"), F.lit(False)) | v.isNull()


def text(v: Column) -> Column:
    """The string of a STRING value, NULL for every other type."""
    return F.when(is_string(v), F.try_variant_get(v, "$", "string"))


def scalar_text(v: Column) -> Column:
    """Strings as they are; numbers and booleans the way Python's ``str`` prints them."""
    raw = F.try_variant_get(v, "$", "string")
    return (
        F.when(is_string(v), raw)
        .when(has_type(v, "BOOLEAN"), F.initcap(raw))
        .when(is_number(v), raw)
    )


def items(v: Column) -> Column:
    """``array<variant>`` of an ARRAY value, NULL otherwise."""
    return F.when(is_array(v), F.try_variant_get(v, "$", "array<variant>"))


def as_json(v: Column) -> Column:
    return F.when(v.isNotNull(), F.to_json(v))


def empty_items() -> Column:
    return F.array().cast("array<variant>")


def listed(v: Column, *single: str) -> Column:
    """Items of a list; an object (or a value of a ``single`` type) counts as a list of one."""
    return F.when(has_type(v, "OBJECT", *single), F.array(v)).otherwise(items(v))

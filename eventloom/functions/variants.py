"""Strict reading of parsed JSON: casts coerce, so every value carries its kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP_OF_VARIANT = "map<string,variant>"
ARRAY_OF_VARIANT = "array<variant>"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def fields_of(value: Column, names: tuple[str, ...]) -> Column:
    """Struct of the named members, NULL where absent; NULL if not an object."""
    members = ", ".join(f"{name}: variant" for name in names)
    return F.try_variant_get(value, "$", f"struct<{members}>")


def kind_of(value: Column) -> Column:
    """Type of a parsed value as SQL text; ``VOID`` for JSON null, NULL if absent."""
    return F.schema_of_variant(value)


def leaf(value: Column) -> Column:
    return F.struct(
        kind_of(value).alias("kind"), F.try_variant_get(value, "$", "string").alias("text")
    )


def as_map(value: Column) -> Column:
    return F.try_variant_get(value, "$", MAP_OF_VARIANT)


def as_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", ARRAY_OF_VARIANT)


def containers(values: Column) -> Column:
    """The objects and arrays among ``values``, opened one level."""
    opened = F.transform(
        values, lambda v: F.struct(as_map(v).alias("members"), as_array(v).alias("items"))
    )
    return F.filter(opened, lambda c: c["members"].isNotNull() | c["items"].isNotNull())


def children(opened: Column) -> Column:
    """All values one level below the given containers."""
    return F.flatten(
        F.transform(opened, lambda c: F.coalesce(F.map_values(c["members"]), c["items"]))
    )

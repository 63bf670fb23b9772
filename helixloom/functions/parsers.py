"""Named parser functions and value dictionaries used by configured field mappings."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.functions.scalars import column

_PARSERS: dict[str, Callable[..., Column]] = {}


def register_parser(name: str, fn: Callable[..., Column]) -> None:
    """Make a Column-to-Column function known by name to field mappings."""
    _PARSERS[name] = fn


def parser(name: str) -> Callable[..., Column]:
    if name not in _PARSERS:
        raise KeyError(f"no parser registered as {name!r}; known: {sorted(_PARSERS)}")
    return _PARSERS[name]


def map_values(c: Column | str, values: Mapping[str, str]) -> Column:
    """Replace values found in the dictionary and keep the others."""
    c = column(c)
    if not values:
        return c
    # Two literal arrays make one map constant, however long the dictionary is.
    table = F.map_from_arrays(F.lit(list(values)), F.lit(list(values.values())))
    return F.coalesce(F.try_element_at(table, c), c)


def map_values_table(df: DataFrame, field: str, table: DataFrame) -> DataFrame:
    """The same for a dictionary of any size, given as a table (value, mapped)."""
    names = table.select(F.col("value").alias("_value"), F.col("mapped").alias("_mapped"))
    joined = df.join(names, F.col(field) == F.col("_value"), "left")
    return joined.select(*[
        F.coalesce("_mapped", field).alias(c) if c == field else F.col(f"`{c}`") for c in df.columns
    ])

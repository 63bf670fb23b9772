"""Distinct values of fields with counts, in natural order, and small result summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixloom.functions.scalars import natural_key

# Slices in which the best values of one field are picked before they meet in one place.
TOP_SLICES = 64


def _kept(kind: T.DataType, c: Column) -> Column:
    """Empty text, zero and false are not offered as choices."""
    if isinstance(kind, T.NumericType):
        return c.isNotNull() & (c != 0)
    if isinstance(kind, T.BooleanType):
        return c
    return c.isNotNull() & (c.cast("string") != "")


def _field_values(df: DataFrame, field: str) -> tuple[DataFrame, T.DataType]:
    """One row per occurrence: a document counts a value once, a nested element each time."""
    if field in df.columns:
        kind = df.schema[field].dataType
        if isinstance(kind, T.ArrayType):
            return df.select(F.explode(F.array_distinct(field)).alias("value")), kind.elementType
        return df.select(F.col(f"`{field}`").alias("value")), kind
    path, member = field.split(".", 1)
    kind = df.schema[path].dataType.elementType[member].dataType
    if isinstance(kind, T.ArrayType):
        exploded = df.select(F.explode(F.flatten(F.col(path)[member])).alias("value"))
        return exploded, kind.elementType
    return df.select(F.explode(path).alias("e")).select(F.col(f"e.{member}").alias("value")), kind


def facet(df: DataFrame, field: str, top: int | None = None) -> DataFrame:
    """The values of a flat field or ``path.field``, or the ``top`` most frequent: value, n, position.

    Counting combines map-side; ties go to the smaller value, so the choice is stable. Only the
    chosen values, at most ``top``, are put into natural order.
    """
    rows, kind = _field_values(df, field)
    counts = rows.filter(_kept(kind, F.col("value"))).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    best = _best(counts.withColumn("field", F.lit(field)), top)
    order = Window.partitionBy("field").orderBy(natural_key("value"), F.col("value"))
    return best.select("value", "n", F.row_number().over(order).alias("position"))


def _best(counts: DataFrame, top: int | None) -> DataFrame:
    """The ``top`` most frequent of (field, value, n), picked inside hashed slices before the slices' winners meet."""
    if top is None:
        return counts
    best_first = [F.desc("n"), F.asc("value")]
    sliced = counts.withColumn("slice", F.pmod(F.xxhash64("value"), F.lit(TOP_SLICES)))
    near = (sliced.withColumn("r", F.row_number().over(Window.partitionBy("field", "slice").orderBy(*best_first)))
            .filter(F.col("r") <= top))
    return (near.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy(*best_first)))
            .filter(F.col("r") <= top))


# Fields counted by one pass of grouping sets.
FIELDS_PER_PASS = 30


def _scalar_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, value, n) of plain columns, one grouping set each: combined map-side, all in codegen."""
    names = [f"c{i}" for i in range(len(fields))]
    cut = df.select(*[F.col(f"`{f}`").alias(n) for f, n in zip(fields, names)])
    full = (1 << len(names)) - 1
    own_bit = [full - (1 << (len(names) - 1 - i)) for i in range(len(names))]
    counted = cut.groupingSets([[n] for n in names], *names).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"))
    label = F.create_map(*[F.lit(x) for pair in zip(own_bit, fields) for x in pair])
    value = F.coalesce(*[F.when(_kept(cut.schema[n].dataType, F.col(n)), F.col(n).cast("string")) for n in names])
    return counted.select(F.element_at(label, F.col("_g").cast("int")).alias("field"), value.alias("value"), "n").filter(F.col("value").isNotNull())


def _labelled(values: Column, kind: T.DataType, field: str) -> Column:
    kept = F.filter(values, lambda v: _kept(kind, v))
    return F.transform(kept, lambda v: F.struct(F.lit(field).alias("field"), v.cast("string").alias("value")))


def _array_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The same for array columns and members of nested arrays, exploded in one pass."""
    pairs = []
    for f in fields:
        if f in df.columns:
            kind, values = df.schema[f].dataType.elementType, F.array_distinct(F.col(f"`{f}`"))
        else:
            path, member = f.split(".", 1)
            kind, values = df.schema[path].dataType.elementType[member].dataType, F.col(path)[member]
            if isinstance(kind, T.ArrayType):
                values, kind = F.flatten(values), kind.elementType
        pairs.append(_labelled(values, kind, f))
    empty = F.array().cast("array<struct<field:string,value:string>>")
    exploded = df.select(F.explode(F.concat(*[F.coalesce(p, empty) for p in pairs])).alias("p"))
    return exploded.groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def facets(df: DataFrame, fields: Sequence[str], top: int | None = None) -> DataFrame:
    """All facets at once: field, value (text), n, position.

    The best values are first picked inside hashed slices of each field and then among the
    slices' winners, so a field with very many values never gathers them all in one task.
    """
    scalars = [f for f in fields if f in df.columns and not isinstance(df.schema[f].dataType, T.ArrayType)]
    arrays = [f for f in fields if f not in scalars]
    parts = [_scalar_counts(df, scalars[i:i + FIELDS_PER_PASS]) for i in range(0, len(scalars), FIELDS_PER_PASS)]
    parts += [_array_counts(df, arrays)] if arrays else []
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    best = _best(counts, top)
    order = Window.partitionBy("field").orderBy(natural_key("value"), F.col("value"))
    return best.select("field", "value", "n", F.row_number().over(order).alias("position"))


def long_facets(tables: Mapping[str, DataFrame], fields: Sequence[str], top: int | None = None) -> DataFrame:
    """The same for the long layout: each field is counted in the table that holds it."""
    parts = []
    for name, table in tables.items():
        mine = [f for f in fields if (f.split(".", 1)[0] if "." in f else "") == name]
        if mine:
            members = {f: (f.split(".", 1)[1] if name else f) for f in mine}
            cut = table.select(*[F.col(f"`{m}`") for m in members.values()])
            named = {m: f for f, m in members.items()}
            part = facets(cut, list(members.values()), top)
            label = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])
            parts.append(part.withColumn("field", F.element_at(label, F.col("field"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gene_list(df: DataFrame, c: str = "SYMBOL", sep: str = "|") -> DataFrame:
    """One row: the distinct gene symbols of a result, sorted and joined."""
    symbols = df.select(F.col(c).alias("s")).filter(~F.col("s").isin("", "NA")).distinct()
    return symbols.agg(F.array_join(F.sort_array(F.collect_list("s")), sep).alias("genes"))


def family_count(df: DataFrame, family: str = "Family_ID") -> DataFrame:
    return df.select(family).distinct().agg(F.count(family).alias("families"))

"""Long rows to documents with arrays, and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _element(fields: Sequence[str] | Mapping[str, str]) -> Column:
    names = dict(fields) if isinstance(fields, Mapping) else {f: f for f in fields}
    return F.struct(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])


def nest(df: DataFrame, keys: Sequence[str], path: str, fields: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """One document per key with ``path`` as an array of structs, elements in a stable order.

    ``fields`` are the element members, or source column -> member name. The array of a key is
    gathered in one place, so this is for groups of bounded size; documents beyond that stay in
    the long layout (``Tables``), which every search and facet reads as well.
    """
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(_element(fields))).alias(path))


def nest_in_parts(df: DataFrame, keys: Sequence[str], path: str, fields: Sequence[str] | Mapping[str, str], parts: int) -> DataFrame:
    """Rows (keys, part, path): a key's elements dealt out over up to ``parts`` rows.

    For sinks that cap the size of an array. These rows are not documents: what counts or limits
    elements per document does not apply to them.
    """
    element = _element(fields)
    # Copies of one element are counted before they travel, then dealt out over the parts.
    counted = df.groupBy(*keys, element.alias("_e")).agg(F.count(F.lit(1)).alias("_n"))
    share = F.ceil(F.col("_n") / parts)
    dealt = counted.withColumn("_share", share).select(
        *keys, "_e", "_n", "_share", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / F.col("_share")) - 1)).alias("_i"))
    copies = F.least(F.col("_share"), F.col("_n") - F.col("_i") * F.col("_share")).cast("int")
    part = F.pmod(F.xxhash64("_e") + F.col("_i"), F.lit(parts)).cast("int")
    grouped = (dealt.select(*keys, part.alias("part"), F.struct("_e", copies.alias("_n")).alias("_s"))
               .groupBy(*keys, "part").agg(F.sort_array(F.collect_list("_s")).alias("_es")))
    return grouped.select(*keys, "part", F.flatten(F.transform("_es", lambda x: F.array_repeat(x["_e"], x["_n"]))).alias(path))


def unnest(df: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """The long layout: one row per element."""
    return df.select(*keys, F.explode(path).alias("_e")).select(*keys, "_e.*")

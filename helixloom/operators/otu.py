"""Taxon-by-sample tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.operators.indexing import global_index
from helixloom.operators.sizing import written

MAX_SAMPLES = 10_000


def sample_ids(df: DataFrame, sample: str) -> list[str]:
    """Sorted sample ids for the column headings; refuses more than a table can have."""
    rows = df.select(sample).distinct().filter(F.col(sample).isNotNull()).limit(MAX_SAMPLES + 1).collect()
    if len(rows) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} samples: use otu_long")
    return sorted(r[0] for r in rows)


def _cell(value: str, order: str | Column | None, agg: str) -> Column:
    if agg == "sum":
        return F.sum(value)
    if agg != "last":
        raise ValueError(f"agg is 'last' or 'sum', not {agg!r}")
    if order is None:
        raise ValueError("the last value needs an order")
    return F.max_by(value, order)


def otu_table(df: DataFrame, samples: Sequence[str], tax: str = "taxonomy", sample: str = "BMlabid",
              value: str = "value", order: str | Column | None = None, agg: str = "last") -> DataFrame:
    """Rows are taxa, columns are sample ids, missing cells are 0, ids follow taxon order.

    Several values for one cell: the last by ``order`` wins, or ``agg='sum'`` adds them. ``samples``
    are all samples of the data (``sample_ids``); a row of another one fails, it is not dropped.
    """
    known = F.col(sample).isNull() | F.col(sample).isin(list(samples))
    df = df.withColumn(sample, F.when(known, F.col(sample)).otherwise(F.raise_error(F.concat(F.lit("sample without a column: "), F.col(sample)))))
    cells = df.groupBy(tax).pivot(sample, list(samples)).agg(_cell(value, order, agg)).fillna(0, subset=list(samples))
    # Numbering reads the taxa several times; they and the finished cells are stored first.
    cells = written(cells, "otu")
    numbered = cells.join(global_index(cells.select(tax).distinct(), tax, "_i"), tax)
    return numbered.select(F.concat(F.lit("OTU_"), F.col("_i").cast("string")).alias("OTU_ID"),
                           *[F.col(f"`{s}`") for s in samples], tax)


def otu_long(df: DataFrame, tax: str = "taxonomy", sample: str = "BMlabid", value: str = "value",
             order: str | Column | None = None, agg: str = "last") -> DataFrame:
    """The same cells without column headings, for any number of samples: id, taxon, sample, value."""
    cells = written(df.groupBy(tax, sample).agg(_cell(value, order, agg).alias("value")), "otu")
    ids = global_index(cells.select(tax).distinct(), tax, "_i")
    return cells.join(ids, tax).select(F.concat(F.lit("OTU_"), F.col("_i").cast("string")).alias("OTU_ID"), tax, sample, "value")

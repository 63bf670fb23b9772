"""Running numbers over a whole sorted table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOUNDARY_SAMPLE = 20_000
BOUNDARIES = 256


def global_index(df: DataFrame, c: str, out: str = "index") -> DataFrame:
    """Number the rows 0, 1, 2 ... by the unique text column ``c``.

    A fixed-size hash sample gives split points. They are literals, so every attempt of a task
    cuts the rows alike; they only steer balance, not the result. Each range is numbered on its
    own and shifted by the sizes of the ranges before it, a table of at most 257 rows. The input is
    read three times: store a costly one first.
    """
    sample = df.select(c).orderBy(F.xxhash64(c), F.col(c)).limit(BOUNDARY_SAMPLE).collect()
    values = sorted((r[0] for r in sample if r[0] is not None), key=lambda v: v.encode())
    step = max(1, len(values) // BOUNDARIES)
    points = values[step::step]
    bucket = F.size(F.filter(F.lit(points), lambda p: p <= F.col(c))) if points else F.lit(0)
    rows = df.withColumn("_b", bucket)
    sizes = rows.groupBy("_b").count()
    shift = F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_b", shift.alias("_shift"))
    numbered = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(c)))
    return numbered.join(offsets, "_b").withColumn(out, F.col("_shift") + F.col("_r") - 1).drop("_b", "_r", "_shift")

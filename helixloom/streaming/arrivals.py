"""VCF batches that keep arriving.

Data is otherwise loaded in one go; this runs the ordinary load on files as they come in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """New VCF files of a folder as they appear, one text line per row."""
    return spark.readStream.text(folder)


def append_batch(root: str, transform: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that stores each micro-batch under its own number.

    Nothing stored before is rewritten, so the cost of a batch is its own size, and a batch tried
    again after a failure replaces exactly itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return write


def current(spark: SparkSession, root: str, keys: Sequence[str]) -> DataFrame:
    """The latest row per key over all batches; of two in one batch the greater content wins."""
    rows = spark.read.parquet(root)
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    latest = rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("r"))
    return latest.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def compact(spark: SparkSession, root: str, target: str, keys: Sequence[str]) -> None:
    """Write the current rows as batch 0 of a new root, to go on from there."""
    current(spark, root, keys).write.mode("overwrite").parquet(f"{target}/batch=0")

"""Sides of checked size, small inputs spread out, results written once for several readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A pedigree row is a few hundred bytes, so this stays well below the 8 GB broadcast limit.
BROADCAST_ROWS = 200_000
# Narrow rows that one task gathers, joins and makes distinct, at some 600 bytes of its memory each.
ROWS_PER_PART = 500_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """One short job that stops counting just above the bound."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if(small: bool, df: DataFrame) -> DataFrame:
    """Hint a broadcast for a side of checked size; beyond it Spark joins by shuffle and splits skew."""
    return F.broadcast(df) if small else df


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out over all cores when the input came as fewer partitions than there are cores.

    One small file is one partition, and so is one gzip file of any size; rows that are about to
    be multiplied or parsed should not stay in it. Inputs with enough partitions are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parts_for(*tables: DataFrame) -> int:
    """Partitions in which rows of these tables meet by key, so that a task's share does not grow with the tables.

    Adaptive execution sizes partitions by their compressed bytes, and millions of narrow rows fit in
    one. This counts the rows: give it tables whose count is cheap.
    """
    cores = tables[0].sparkSession.sparkContext.defaultParallelism
    return max(cores, -(-sum(t.count() for t in tables) // ROWS_PER_PART))


def shared_folder(spark: SparkSession) -> str:
    """The folder driver and executors share, as the session names it. Its owner removes what is in it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/")


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write once to the shared folder and go on from there.

    Several outputs of one costly plan then read columns of a stored table, and a lost executor
    costs a re-read and not the whole lineage.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)

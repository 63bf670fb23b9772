"""Pedigree text: 6 or 13 blank-separated columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.functions import vocab as V


def split_pedigree(lines: DataFrame) -> DataFrame:
    """One row per sample; ``-9`` and ``NA`` are missing, ``#`` lines are skipped.

    A line with another number of columns fails the read with its text.
    """
    v = F.trim(F.col("value"))
    rows = lines.filter(~v.startswith("#")).filter(v != "").select(F.split(v, r"\s+").alias("p"), v.alias("v"))
    wrong = F.raise_error(F.concat(F.lit("pedigree line needs 6 or 13 columns: "), F.col("v")))
    checked = rows.select(F.when(F.size("p").isin(6, 13), F.col("p")).otherwise(wrong.cast("array<string>")).alias("p"))
    values = [F.get("p", F.lit(i)) for i in range(len(V.PED_COLUMNS))]
    return checked.select(*[F.when(~x.isin(V.PED_MISSING), x).alias(n) for x, n in zip(values, V.PED_COLUMNS)])


def read_ped(spark: SparkSession, path: str) -> DataFrame:
    return split_pedigree(spark.read.text(path))

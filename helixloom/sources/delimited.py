"""CSV with one row per variant and sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Columns of the row-per-sample file.
SAMPLE_ROWS = T.StructType([
    T.StructField("Variant", T.StringType()), T.StructField("CHROM", T.StringType()), T.StructField("POS", T.IntegerType()),
    T.StructField("dbSNP_ID", T.StringType()), T.StructField("REF", T.StringType()), T.StructField("ALT", T.StringType()),
    T.StructField("VariantType", T.StringType()), T.StructField("Sample_ID", T.StringType()), T.StructField("GT", T.StringType()),
    T.StructField("ExonicFunc_refGene", T.StringType()),
])


def read_sample_rows(spark: SparkSession, path: str, schema: T.StructType = SAMPLE_ROWS) -> DataFrame:
    """Typed by a stated schema, not by a guess over the data; ``None`` and empty are missing."""
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=False, nullValue="None")
    return df

"""CSV sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from helixloom.operators.shaping import label_columns, stringify


def export_csv(df: DataFrame, path: str, labels: Mapping[str, str] | None = None, missing: str = "None",
               mode: str = "overwrite") -> None:
    """The whole result as CSV with a header, written by all tasks; missing values as ``None``."""
    stringify(label_columns(df, labels or {}), missing).write.mode(mode).csv(path, header=True, emptyValue="")


def export_otu_csv(otu: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A taxon-by-sample table under its conventional first heading."""
    otu.withColumnRenamed("OTU_ID", "#OTU ID").write.mode(mode).csv(path, header=True)

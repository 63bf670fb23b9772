"""Searches kept as rows: a log to replay and specs saved by users."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.plans.spec import QuerySpec, run_spec, search_mode
from helixloom.sources.export import export_csv
from helixloom.sources.warehouse import Tables

SCHEMA = "id string, user string, dataset string, name string, spec string, created timestamp"


def log_row(spark: SparkSession, id: str, user: str, dataset: str, spec: QuerySpec, name: str | None = None) -> DataFrame:
    row = [(id, user, dataset, name, spec.to_json())]
    return (spark.createDataFrame(row, "id string, user string, dataset string, name string, spec string")
            .withColumn("created", F.current_timestamp()))


def log_spec(row: DataFrame, path: str) -> None:
    """Append one run to the log."""
    row.write.mode("append").parquet(path)


def logged(log: DataFrame, id: str) -> tuple[QuerySpec, str]:
    """A logged search and its dataset."""
    found = log.filter(F.col("id") == id).select("spec", "dataset").first()
    if found is None:
        raise KeyError(f"no logged search {id!r}")
    return QuerySpec.from_json(found["spec"]), found["dataset"]


def replay(log: DataFrame, id: str, tables: Tables, reviews: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """Run a logged search again without its row limit; reviews of its own dataset count."""
    spec, dataset = logged(log, id)
    return run_spec(tables, spec, reviews, group, limit=None, dataset=dataset)


def export_logged(log: DataFrame, id: str, tables: Tables, path: str, labels: Mapping[str, str] | None = None,
                  reviews: DataFrame | None = None, group: str | None = None) -> None:
    """The whole result of a logged search, plain or by inheritance mode, as CSV."""
    export_csv(replay(log, id, tables, reviews, group), path, labels)


def export_mode_csv(tables: Tables, mode: str, spec: QuerySpec, path: str, labels: Mapping[str, str] | None = None,
                    reviews: DataFrame | None = None, group: str | None = None, dataset: str | None = None) -> None:
    """The whole result of a search by inheritance mode as CSV."""
    export_csv(search_mode(tables, mode, spec, reviews=reviews, group=group, limit=None, dataset=dataset), path, labels)


def saved_specs(log: DataFrame, user: str, catalog: DataFrame) -> DataFrame:
    """One row per filter of a user's saved specs, with the field's display text.

    The spec text is read with a typed schema inside Spark and joined to the catalog.
    """
    shape = ("struct<filters:array<struct<kind:string,field:string,path:string,value:string>>,"
             "attributes:array<struct<field:string,path:string>>>")
    mine = log.filter((F.col("user") == user) & F.col("name").isNotNull())
    read = mine.select("id", "name", "dataset", F.from_json("spec", shape).alias("s"))
    rows = read.select("id", "name", "dataset", F.explode_outer("s.filters").alias("f")).select(
        "id", "name", "dataset", "f.kind", F.col("f.field").alias("field"), F.coalesce("f.path", F.lit("")).alias("path"), "f.value")
    shown = catalog.select("field", F.coalesce("path", F.lit("")).alias("path"), "display_text")
    return rows.join(shown, ["field", "path"], "left").select("id", "name", "dataset", "path", "field", "display_text", "kind", "value")

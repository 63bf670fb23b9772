"""Curators' decisions about documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["group", "dataset", "document"]


def apply_reviews(reviews: DataFrame, events: DataFrame) -> DataFrame:
    """Current reviews after new events (group, dataset, document, status, description, ts).

    The latest status of a document counts, ``Delete`` removes the review. Setting the same
    status again changes nothing but is harmless. ``max_by`` combines map-side.
    """
    columns = [*KEYS, "status", "description", "ts"]
    every = reviews.select(*columns).unionByName(events.select(*columns))
    last = every.groupBy(*KEYS).agg(F.max_by(F.struct("status", "description", "ts"), F.struct("ts", "status")).alias("r"))
    return last.select(*KEYS, "r.*").filter(F.col("status") != "Delete")


def reviews_for(reviews: DataFrame, groups: Sequence[str]) -> DataFrame:
    return reviews.filter(F.col("group").isin(list(groups)))


def review_history(events: DataFrame) -> DataFrame:
    """Every review with the time it was in force: group, dataset, document, status, description, reviewer, valid_from, valid_to.

    Events: group, dataset, document, status, description, reviewer, ts. A review holds from its ts up to the ts of the next other
    status, for ever (valid_to null) if none follows; ``Delete`` ends one and starts none. Of events of one document at one ts the
    last by status, then reviewer counts. The same status again changes nothing: the review stays with whoever gave it first.
    Events without ts or document are left out. All steps share one shuffle and one sort.
    """
    turn = Window.partitionBy(*KEYS).orderBy("ts", "status", "reviewer", "description")
    timed = events.filter("ts is not null and document is not null").select(*KEYS, "status", "description", "reviewer", "ts")
    last = timed.withColumn("next", F.lead("ts").over(turn)).filter("next is null or next > ts")
    changes = last.withColumn("before", F.lag("status").over(turn)).filter("not before <=> status")
    spans = changes.withColumn("valid_to", F.lead("ts").over(turn)).filter("status <> 'Delete'")
    return spans.select(*KEYS, "status", "description", "reviewer", F.col("ts").alias("valid_from"), "valid_to")


def reviews_as_of(history: DataFrame, as_of: object) -> DataFrame:
    """The reviews of `review_history` that were in force at that time."""
    return history.filter((F.col("valid_from") <= F.lit(as_of)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(as_of))))


def review_at(df: DataFrame, history: DataFrame, group: str, dataset: str, key: str, at: str) -> DataFrame:
    """Each row with the review its document (column `key`) had at the row's own time (column `at`): status and reviewer, null if none.

    An equi-join on the document with the interval as condition: at most one interval holds at a time, so no row is repeated.
    """
    one = history.filter((F.col("group") == group) & (F.col("dataset") == dataset))
    one = one.select(F.col("document").alias("_document"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), "status", "reviewer")
    held = (F.col(key) == F.col("_document")) & (F.col(at) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(at) < F.col("_to")))
    return df.join(one, held, "left").drop("_document", "_from", "_to")


def exclude_rejected(df: DataFrame, reviews: DataFrame, group: str | None, key: str = "variant_key", dataset: str | None = None, as_of: object = None) -> DataFrame:
    """Drop documents the reviewer's group rejected in this dataset. Without one group results stay as they are.

    The same document may stand in several datasets, so the dataset has to be named. With `as_of`, `reviews` is a
    history and the reviews in force at that time count.
    """
    if group is None:
        return df
    if dataset is None:
        raise ValueError("name the dataset whose reviews count")
    if as_of is not None:
        reviews = reviews_as_of(reviews, as_of)
    rejected = reviews.filter((F.col("group") == group) & (F.col("dataset") == dataset) & (F.col("status") == "Rejected"))
    return df.join(rejected.select(F.col("document").alias(key)).distinct(), key, "left_anti")

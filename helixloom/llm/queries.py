"""Registered queries: each operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm import (decontaminate, exact_dedup, hard_negatives, html_extract, license_scan, line_dedup, mixing, quality, simhash, spelling, sql,
                           substring_dedup, toxicity, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, twin: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if twin is not None:
            ORACLES[name] = twin
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_license_scan", sql.LICENSE_SCAN)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf, "documents"), license_scan.catalog(spark))
    return found.withColumn("licenses", F.array_join("licenses", ","))


@query("op2_decontaminate", sql.DECONTAMINATE)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.annotate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op3_line_dedup", sql.LINE_DEDUP)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.annotate(table(spark, sf, "documents"))


@query("op4_mixing", sql.MIXING)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"), target_entropy=sql.ENTROPY, seed=sql.SEED)
    return mixed.select("doc_id", "source", "mix.epoch", "mix.block", "mix.place", "mix.tokens", F.round("mix.weight", 6).alias("weight"))


@query("op5_exact_dedup", sql.EXACT_DEDUP)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.annotate(table(spark, sf, "documents"))


# The contract's rules: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


@query("op6_url_filter")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages"), URL_RULES, url_filter.labelled_urls(spark))


@query("op7_quality")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return quality.annotate(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op8_substring_dedup", sql.SUBSTRING_DEDUP)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.annotate(table(spark, sf, "documents")).drop("factors")


@query("op9_html_extract")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.extract(table(spark, sf, "pages"))


@query("op10_simhash")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.annotate(table(spark, sf, "documents"))


@query("op11_spelling_variants", sql.SPELLING_VARIANTS)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.annotate(table(spark, sf, "documents"))


@query("op12_hard_negatives", sql.HARD_NEGATIVES)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    # The contract's scale, anchors and moved labels.
    found = table(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    anchor = F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))
    return hard_negatives.mine(found.select("vec_id", label.alias("label"), hard_negatives.whole_vectors("embedding", 256).alias("vector"), anchor.alias("anchor")))


@query("op13_toxicity")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.annotate(table(spark, sf, "documents"), table(spark, sf, "labels"))

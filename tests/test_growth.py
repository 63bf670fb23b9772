"""Inputs larger than the given tables: wide positions, small stored files, wide documents."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from helixloom.operators import sizing
from helixloom.plans.load import load_vcf
from helixloom.sources.warehouse import get_variant, read_tables, replace_partitions, write_tables, write_warehouse
from workloads import derive as D
from workloads import vcf_text as T
from workloads.storage import HEADER, write_vcf

KEYS = [3, 107_374, 107_375, 8_000_000]


def _parts(spark, path) -> str:
    """A part table with keys whose positions need more than 32 bits."""
    rows = [(k, f"Brand#{k % 3}", "SMALL", k % 50, 1.5) for k in KEYS]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{path}/part.parquet")
    return str(path)


def test_positions_beyond_32_bits(spark, tmp_path):
    sf = _parts(spark, tmp_path)
    assert sorted(r["POS"] for r in D.variants(spark, sf).collect()) == [k * 20_000 for k in KEYS]
    assert sorted(r["k"] for r in T.parsed(spark, sf).select("k").collect()) == KEYS


def test_wide_positions_are_loaded_stored_and_read(spark, tmp_path):
    sf = _parts(spark, tmp_path)
    tables, rejects = load_vcf(spark, write_vcf(spark, HEADER, T.lines(spark, sf)), profile=False)
    assert rejects.isEmpty()
    write_tables(tables, str(tmp_path / "store"), bucket=5)
    back = read_tables(spark, str(tmp_path / "store"))
    assert sorted(r["POS"] for r in back.base.collect()) == [k * 20_000 for k in KEYS]
    assert back.paths["sample"].filter(F.col("POS") == KEYS[-1] * 20_000).count() > 0


def test_key_filters_of_small_files_are_small(spark, tmp_path):
    rows = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 224).alias("variant_key"), F.lit("1").alias("CHROM"), (F.col("id") * 10).alias("POS"))
    path = str(tmp_path / "store")
    write_warehouse(rows, path, bucket=5_000)
    replace_partitions(rows.filter("POS < 5000"), path, 5_000)
    sizes = [(f.stat().st_size, duckdb.sql(f"SELECT max(bloom_filter_length) FROM parquet_metadata('{f}')").fetchall()[0][0]) for f in (tmp_path / "store").rglob("*.parquet")]
    assert len(sizes) >= 4 and all(size < 100_000 and 0 < kept < 5_000 for size, kept in sizes)
    for key in [r[0] for r in rows.filter("id % 400 = 7").select("variant_key").collect()]:
        assert get_variant(spark.read.parquet(path), key).count() == 1


def test_partitions_of_documents_grow_with_their_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sizing, "ROWS_PER_PART", 100)
    spark.range(1000).select(F.col("id").alias("o_orderkey"), F.lit("F").alias("o_orderstatus")).write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(3000).select(F.expr("id % 900").alias("l_orderkey"), F.expr("int(id div 900)").alias("l_linenumber"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = D.nested_orders(spark, str(tmp_path), ["l_linenumber"])
        assert docs.rdd.getNumPartitions() == 40
        sizes = {r["o_orderkey"]: r["n"] for r in docs.select("o_orderkey", F.coalesce(F.size("line"), F.lit(0)).alias("n")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sizes == {k: 0 if k >= 900 else 4 if k < 300 else 3 for k in range(1000)}

"""Exports, search log, curation, uploads and arriving batches."""

import csv
import glob

import pytest
from pyspark.sql import functions as F

from helixloom.operators import genotypes as N
from helixloom.operators import merging as M
from helixloom.operators.nesting import nest
from helixloom.operators.reviews import exclude_rejected
from helixloom.plans import log as L
from helixloom.plans.spec import Attribute, FieldFilter, QuerySpec
from helixloom.sources.delimited import read_sample_rows
from helixloom.sources.export import export_csv, export_otu_csv
from helixloom.sources.warehouse import Tables
from helixloom.streaming import arrivals as A


def read_csv(folder):
    rows = []
    for f in sorted(glob.glob(f"{folder}/part-*.csv")):
        with open(f, newline="") as fh:
            got = list(csv.reader(fh))
            rows += got if not rows else got[1:]
    return rows


def test_export_csv(spark, tmp_path):
    df = spark.sql("SELECT 1 AS k, cast(null AS string) AS v, array('a', 'b') AS l")
    export_csv(df, str(tmp_path / "out"), {"v": "Value"})
    assert read_csv(tmp_path / "out") == [["k", "Value", "l"], ["1", "None", '["a","b"]']] or \
        read_csv(tmp_path / "out")[1][:2] == ["1", "None"]


def test_export_otu(spark, tmp_path):
    export_otu_csv(spark.sql("SELECT 'OTU_0' AS OTU_ID, 1.0D AS s1, 't' AS taxonomy"), str(tmp_path / "otu"))
    assert read_csv(tmp_path / "otu") == [["#OTU ID", "s1", "taxonomy"], ["OTU_0", "1.0", "t"]]


@pytest.fixture()
def tables(spark):
    base = spark.createDataFrame([(i, i * 10) for i in range(600)], "variant_key int, POS int")
    rows = spark.createDataFrame([(i, f"s{i % 3}") for i in range(600)], "variant_key int, Sample_ID string")
    return Tables(base, {"sample": rows})


def test_log_replay_export(spark, tables, tmp_path):
    spec = QuerySpec([Attribute("POS"), Attribute("Sample_ID", "sample")], [FieldFilter("filter_range_gte", "POS", "1000")], exclude_rejected=True)
    L.log_spec(L.log_row(spark, "q1", "ann", "ds", spec, name="mine"), str(tmp_path / "log"))
    L.log_spec(L.log_row(spark, "q2", "bob", "ds", QuerySpec([Attribute("POS")])), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    reviews = spark.sql("SELECT 'lab' AS `group`, 'ds' AS dataset, 150 AS document, 'Rejected' AS status")
    assert L.replay(log, "q1", tables).count() == 500
    assert L.replay(log, "q1", tables, reviews, "lab").count() == 499
    assert L.replay(log, "q1", tables, reviews, None).count() == 500
    L.export_logged(log, "q1", tables, str(tmp_path / "csv"), {"POS": "Position"}, reviews, "lab")
    rows = read_csv(tmp_path / "csv")
    assert rows[0] == ["variant_key", "Position", "Sample_ID"] and len(rows) == 500
    catalog = spark.sql("SELECT 'POS' AS field, cast(null AS string) AS path, 'Position' AS display_text")
    saved = L.saved_specs(log, "ann", catalog).collect()
    assert [(r["name"], r["display_text"], r["value"]) for r in saved] == [("mine", "Position", "1000")]
    with pytest.raises(KeyError):
        L.replay(log, "none", tables)


def test_reviews_only_hide_for_their_group(spark, tables):
    reviews = spark.sql("SELECT * FROM VALUES ('lab', 1, 'Rejected'), ('lab', 2, 'Approved'), ('clinic', 3, 'Rejected') AS t(`group`, document, status)").selectExpr("*", "'ds' AS dataset")
    assert exclude_rejected(tables.base, reviews, "lab", dataset="ds").count() == 599
    assert exclude_rejected(tables.base, reviews, "lab", dataset="other").count() == 600
    with pytest.raises(ValueError):
        exclude_rejected(tables.base, reviews, "lab")


def test_sample_rows_to_documents(spark, tmp_path):
    lines = ["Variant,CHROM,POS,dbSNP_ID,REF,ALT,VariantType,Sample_ID,GT,ExonicFunc_refGene"]
    for variant, rs in (("19_51274150_C_CCT", "rs747001231"), ("X_24382427_CTCCTGCTCC_C", "None")):
        chrom, pos, ref, alt = variant.split("_")
        lines += [f"{variant},{chrom},{pos},{rs},{ref},{alt},INDEL,XG40{i},0/{i % 2},frameshift_insertion" for i in range(4)]
    (tmp_path / "rows.csv").write_text("\n".join(lines) + "\n")
    rows = read_sample_rows(spark, str(tmp_path / "rows.csv"))
    keys = [c for c in rows.columns if c not in ("Sample_ID", "GT")]
    docs = {r["Variant"]: r for r in nest(rows, keys, "sample", {"Sample_ID": "Sample_ID", "GT": "Sample_GT"}).collect()}
    assert len(docs) == 2 and docs["X_24382427_CTCCTGCTCC_C"]["dbSNP_ID"] is None
    assert [(e["Sample_ID"], e["Sample_GT"]) for e in docs["19_51274150_C_CCT"]["sample"]] == [("XG400", "0/0"), ("XG401", "0/1"), ("XG402", "0/0"), ("XG403", "0/1")]


def test_upsert_rows_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "a", 6)], "k int, s string, v int")
    b = spark.createDataFrame([(2, "a", 7), (3, "a", 8)], "k int, s string, v int")
    once = M.upsert_rows(t, b, ["k", "s"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 5), (2, "a", 7), (3, "a", 8)]
    assert sorted(M.upsert_rows(once, b, ["k", "s"]).collect()) == sorted(once.collect())


def test_label_metrics_without_label(spark):
    row = M.label_metrics(spark.sql("SELECT 1 AS k, 2 AS AC, cast('nan' AS double) AS QUAL, 'PASS' AS FILTER"), None).first()
    assert row["AC"] == 2 and row["QUAL"] is None and row["FILTER"][0].asDict() == {"FILTER_value": "PASS"}


def test_arriving_batches(spark, tmp_path):
    inbox, root = tmp_path / "inbox", str(tmp_path / "store")
    inbox.mkdir()

    def rows(lines):
        p = F.split("value", " ")
        return lines.select(p[0].alias("k"), p[1].alias("s"), p[2].cast("int").alias("v"))

    def run():
        q = (A.stream_lines(spark, str(inbox)).writeStream.foreachBatch(A.append_batch(root, rows))
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
        q.awaitTermination(120)

    (inbox / "a.txt").write_text("v1 s1 1\nv2 s1 2\n")
    run()
    (inbox / "b.txt").write_text("v2 s1 9\nv3 s1 3\n")
    run()
    want = [("v1", "s1", 1), ("v2", "s1", 9), ("v3", "s1", 3)]
    assert sorted(map(tuple, A.current(spark, root, ["k", "s"]).collect())) == want
    # A batch tried again replaces itself.
    A.append_batch(root, rows)(spark.read.text(str(inbox / "b.txt")), 1)
    assert sorted(map(tuple, A.current(spark, root, ["k", "s"]).collect())) == want
    A.compact(spark, root, str(tmp_path / "next"), ["k", "s"])
    assert sorted(map(tuple, A.current(spark, str(tmp_path / "next"), ["k", "s"]).collect())) == want


def test_trios_and_counts(spark):
    ped = spark.sql("SELECT * FROM VALUES ('f', 'c1', 'd', 'm', '1'), ('f', 'c2', 'd', 'm', '2'), ('f', 'd', null, null, '1') AS t(family, sample, father, mother, sex)")
    assert sorted(r["child"] for r in N.trios(ped).collect()) == ["c1", "c2"]


def test_shared_folder_is_the_named_one(spark):
    from helixloom.operators.sizing import shared_folder, written

    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named.rstrip("/")
    back = written(spark.range(5), "five")
    assert back.count() == 5 and (named is None or back.inputFiles()[0].startswith(named.rstrip("/")) or named.rstrip("/") in back.inputFiles()[0])

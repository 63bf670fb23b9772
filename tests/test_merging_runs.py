"""Variants meet whatever their IDs are; runs added to stores that have other tables and columns; files that a run leaves alone."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helixloom.plans.load import add_run, labelled_run, load_case_control, load_vcf, publish_run
from helixloom.sources.warehouse import read_tables, stored_paths, write_tables

TOP = '##fileformat=VCFv4.2\n##INFO=<ID=AC,Number=1,Type=Integer,Description="x">\n##INFO=<ID=DP,Number=1,Type=Integer,Description="x">\n'
CSQ = '##INFO=<ID=CSQ,Number=.,Type=String,Description="Consequence annotations from Ensembl VEP. Format: Allele|Consequence|SYMBOL{}">\n'
END = '##FORMAT=<ID=GT,Number=1,Type=String,Description="x">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{}\n'


def vcf(folder: Path, name: str, sample: str, lines: list[tuple], members: str | None = None, extra: str = "") -> str:
    text = TOP + extra + (CSQ.format(members) if members is not None else "") + END.format(sample)
    for chrom, pos, ident, info, gt in lines:
        text += f"{chrom}\t{pos}\t{ident}\tA\tC\t50\tPASS\t{info}\tGT\t{gt}\n"
    (folder / name).write_text(text)
    return str(folder / name)


def loaded(spark, path):
    return load_vcf(spark, path, profile=False)[0]


def content(tables) -> dict:
    out = {}
    for name, df in [("variants", tables.base), *tables.paths.items()]:
        out[name] = sorted(str(sorted(r.asDict(True).items(), key=str)) for r in df.collect())
    return out


@pytest.fixture
def parts(spark, tmp_path):
    store = loaded(spark, vcf(tmp_path, "a.vcf", "S1", [("1", 100, "rs5", "AC=1;DP=5;CSQ=C|stop_gained|G1", "0/1"), ("2", 100, "rs6", "AC=1;DP=6;CSQ=C|stop_gained|G2", "0/1"),
                                                        ("2", 90_000, ".", "AC=3;CSQ=C|stop_gained|G3", "1/1")], ""))
    run = loaded(spark, vcf(tmp_path, "b.vcf", "S2", [("2", 100, ".", "AC=7;DP=8;NEW=9", "1/1"), ("2", 300, ".", "AC=2;NEW=4", "0/1")],
                            extra='##INFO=<ID=NEW,Number=1,Type=Integer,Description="x">\n'))
    return store, run


def test_case_and_control_meet_whatever_the_id(spark, tmp_path):
    a = vcf(tmp_path, "case.vcf", "S1", [("1", 100, "rs5", "AC=1;CSQ=C|stop_gained|G1", "0/1"), ("1", 200, "rs1", "AC=1", "0/1"), ("1", 200, "rs2", "AC=2", "0/1")], "")
    b = vcf(tmp_path, "control.vcf", "S2", [("1", 100, ".", "AC=2;CSQ=C|stop_gained|G1", "1/1"), ("1", 300, ".", "AC=9", "1/1")], "")
    tables, _ = load_case_control(spark, a, b, profile=False)
    rows = {r["POS"]: r for r in tables.base.collect()}
    assert tables.base.count() == 3 and (rows[100]["AC_case"], rows[100]["AC_control"], rows[100]["ID"]) == (1, 2, "rs5")
    calls = {(r["POS"], r["Sample_ID"], r["variant_key"]) for r in tables.paths["sample"].collect()}
    assert calls == {(p, s, rows[p]["variant_key"]) for p, s in ((100, "S1"), (100, "S2"), (200, "S1"), (300, "S2"))}
    assert [r["variant_key"] for r in tables.paths["CSQ_nested"].collect()] == [rows[100]["variant_key"]]


def test_a_run_without_the_annotation_keeps_the_stored_tables(spark, tmp_path, parts):
    store, run = parts
    write_tables(labelled_run(store, "r1", ["DP"]), str(tmp_path / "v1"))
    out = add_run(spark, str(tmp_path / "v1"), str(tmp_path / "v2"), run, "r2", ["DP"])
    assert set(out.paths) == {"CSQ_nested", "sample"} and out.paths["CSQ_nested"].count() == 3
    row = out.base.filter("CHROM = '2' and POS = 100").collect()
    assert len(row) == 1 and (row[0]["AC_r1"], row[0]["AC_r2"], row[0]["ID"]) == (1, 7, "rs6")
    assert [e["DP_value"] for e in row[0]["DP"]] == [5 + 1, 8]
    assert out.paths["sample"].filter("CHROM = '2' and POS = 100").select("variant_key").distinct().count() == 1


def test_a_run_with_a_new_table_and_member(spark, tmp_path, parts):
    store, run = parts
    write_tables(labelled_run(run, "r1", ["DP"]), str(tmp_path / "v1"))
    rich = loaded(spark, vcf(tmp_path, "c.vcf", "S3", [("2", 100, ".", "AC=1;CSQ=C|stop_gained|G2|HIGH", "0/1")], "|IMPACT"))
    out = add_run(spark, str(tmp_path / "v1"), str(tmp_path / "v2"), rich, "r2", ["DP"])
    assert set(out.paths) == {"CSQ_nested", "sample"} and out.paths["CSQ_nested"].first()["IMPACT"] == "HIGH"
    poor = add_run(spark, str(tmp_path / "v2"), str(tmp_path / "v3"), store, "r3", ["DP"])
    assert sorted(str(r["IMPACT"]) for r in poor.paths["CSQ_nested"].collect()) == ["HIGH", "None", "None", "None"]


def test_publishing_touches_no_other_file_and_gives_the_rows_of_a_new_version(spark, tmp_path, parts):
    store, run = parts
    first = labelled_run(store, "r1", ["DP"])
    write_tables(first, str(tmp_path / "plain"))
    write_tables(first, str(tmp_path / "store"), bucket=50_000)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    out = publish_run(spark, str(tmp_path / "store"), run, "r2", ["DP"], bucket=50_000)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    alone = {p: t for p, t in before.items() if "CHROM=1" in str(p) or "POS_BUCKET=1" in str(p) or "CSQ_nested" in str(p)}
    assert len(alone) >= 7 and all(after.get(p) == t for p, t in alone.items())
    assert {p for p in before if p not in after} and all("CHROM=2" in str(p) and "POS_BUCKET=0" in str(p) for p in before if p not in after)
    assert content(out) == content(add_run(spark, str(tmp_path / "plain"), str(tmp_path / "next"), run, "r2", ["DP"]))
    assert out.base.filter("CHROM = '1'").first()["NEW"] is None and "POS_BUCKET" not in out.base.columns


def test_publishing_again_changes_nothing(spark, tmp_path, parts):
    store, run = parts
    write_tables(labelled_run(store, "r1", ["DP"]), str(tmp_path / "store"), bucket=50_000)
    once = content(publish_run(spark, str(tmp_path / "store"), run, "r2", ["DP"], bucket=50_000))
    assert content(publish_run(spark, str(tmp_path / "store"), run, "r2", ["DP"], bucket=50_000)) == once


def test_an_empty_run_and_a_store_without_buckets(spark, tmp_path, parts):
    store, run = parts
    write_tables(labelled_run(store, "r1", ["DP"]), str(tmp_path / "store"), bucket=50_000)
    none = type(run)(run.base.filter("false"), {p: r.filter("false") for p, r in run.paths.items()}, run.key, run.unique, run.shared)
    assert content(publish_run(spark, str(tmp_path / "store"), none, "r2", ["DP"], bucket=50_000)) == content(read_tables(spark, str(tmp_path / "store")))
    write_tables(store, str(tmp_path / "plain"))
    assert stored_paths(spark, str(tmp_path / "plain")) == ["CSQ_nested", "sample"]
    with pytest.raises(ValueError, match="without buckets"):
        publish_run(spark, str(tmp_path / "plain"), run, "r2")


def test_only_touched_partitions_are_read(spark, tmp_path, parts):
    store, _ = parts
    write_tables(store, str(tmp_path / "store"), bucket=50_000)
    plan = read_tables(spark, str(tmp_path / "store")).base.filter((F.col("CHROM") == "2") & (F.col("POS") < 500))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(CHROM" in plan

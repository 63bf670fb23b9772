"""Allele-aligned fields of single lines, and the splitter against plain Python."""

import itertools

import pytest
from pyspark.sql import functions as F

from helixloom.operators import alleles as A
from helixloom.operators.info import with_info
from helixloom.plans.load import load_vcf
from helixloom.sources import vcf

HEADER = """##fileformat=VCFv4.2
##INFO=<ID=AC,Number=A,Type=Integer,Description="x">
##INFO=<ID=AF,Number=A,Type=Float,Description="x">
##INFO=<ID=D.R,Number=R,Type=Integer,Description="x">
##INFO=<ID=GL,Number=G,Type=Float,Description="x">
##INFO=<ID=MQ,Number=1,Type=Integer,Description="x">
##FORMAT=<ID=GT,Number=1,Type=String,Description="x">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="x">
##FORMAT=<ID=PL,Number=G,Type=Integer,Description="x">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="x">
"""
COLUMNS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n"
LINES = [
    "1\t10\t.\tA\tC,G\t5\tPASS\tAC=1,2;AF=.1,.2;D.R=7,8,9;GL=0,1,2,3,4,5;MQ=30;DB\tGT:AD:PL:DP\t1/2:1,2,3:0,1,2,3,4,5:9\t2|.:4,5,6:7,8,9",
    "1\t20\t.\tA\tC\t5\tPASS\tAC=x;AF=.;D.R=1,2\tGT:AD\t0/1:1,2\t0|0:3,0",
    # Lists of another length than the header says, a short call, an escaped value.
    "1\t30\t.\tA\tC,G,T\t5\tPASS\tAC=1,2;MQ=1,2;Note=a=b\tGT:AD:PL\t3/1\t./.:1,2",
]


@pytest.fixture
def path(tmp_path):
    (tmp_path / "a.vcf").write_text(HEADER + COLUMNS + "\n".join(LINES) + "\n")
    return str(tmp_path / "a.vcf")


def test_numbers_of_the_header(spark, path):
    c = vcf.read_catalog(spark, path)
    assert c.info_numbers == {"AC": "A", "AF": "A", "D_R": "R", "GL": "G", "MQ": "1"} and c.format_numbers["PL"] == "G"


def test_vectors_hold_every_value(spark, path):
    tables, _ = load_vcf(spark, path, profile=False)
    rows = {r["POS"]: r for r in tables.base.collect()}
    assert (rows[10]["AC"], rows[10]["AC_by_allele"], rows[10]["AF_by_allele"]) == (None, [1, 2], [0.1, 0.2])
    assert rows[10]["D_R_by_allele"] == [7, 8, 9] and rows[10]["GL_by_allele"] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and rows[10]["MQ"] == 30
    assert rows[20]["AC_by_allele"] == [None] and rows[20]["AF_by_allele"] is None and rows[30]["GL_by_allele"] is None


def test_unreadable_values_are_counted(spark, path):
    c = vcf.read_catalog(spark, path)
    raw = vcf.read_vcf(spark, path)
    found = {r["name"]: (r["values"], r["unreadable"]) for r in A.unreadable_values(with_info(raw), c.info, c.info_numbers).collect()}
    assert found == {"AC": (5, 1), "AF": (2, 0), "D_R": (5, 0), "GL": (6, 0), "MQ": (2, 1)}
    assert vcf.ingest_report(raw, catalog=c).first()["unreadable"] == 2
    assert "unreadable" not in vcf.ingest_report(raw).columns


def test_one_line_per_allele(spark, path):
    c = vcf.read_catalog(spark, path)
    raw = vcf.read_vcf(spark, path)
    out = A.split_alleles(raw, c)
    exchanges = [df._jdf.queryExecution().executedPlan().toString().count("Exchange") for df in (raw, out)]
    assert exchanges[0] == exchanges[1]
    rows = {(r["POS"], r["ALT"]): r for r in out.collect()}
    assert set(rows) == {("10", "C"), ("10", "G"), ("20", "C"), ("30", "C"), ("30", "G"), ("30", "T")}
    assert rows["10", "C"]["INFO"] == "AC=1;AF=.1;D.R=7,8;GL=0,1,2;MQ=30;DB" and rows["10", "G"]["INFO"] == "AC=2;AF=.2;D.R=7,9;GL=0,3,5;MQ=30;DB"
    assert rows["10", "C"]["calls"] == ["0/1:1,2:0,1,2:9", "0|.:4,5:7,8"] and rows["10", "G"]["calls"] == ["0/1:1,3:0,3,5:9", "1|.:4,6:7,9"]
    assert rows["20", "C"]["INFO"] == LINES[1].split("\t")[7] and rows["20", "C"]["calls"] == LINES[1].split("\t")[9:]
    assert rows["30", "G"]["INFO"] == "AC=1,2;MQ=1,2;Note=a=b" and rows["30", "T"]["calls"] == ["0/1", "./.:1,2"] and rows["30", "G"]["calls"][0] == "0/0"


def test_genotype_places(spark):
    """The order of G values is that of growing second allele, then growing first."""
    pairs = [(j, k) for k in range(5) for j in range(k + 1)]
    df = spark.createDataFrame(pairs, "j int, k int").select(A.genotype_place(F.col("j"), F.col("k")).alias("p"))
    assert [r["p"] for r in df.collect()] == list(range(len(pairs)))
    assert len(list(itertools.combinations_with_replacement(range(5), 2))) == len(pairs)


def test_no_lines(spark, path):
    c = vcf.read_catalog(spark, path)
    raw = vcf.read_vcf(spark, path).filter("false")
    assert A.split_alleles(raw, c).count() == 0
    assert {r["values"] for r in A.unreadable_values(with_info(raw), c.info, c.info_numbers).collect()} == {0}

from pyspark.sql import functions as F
"""Rule tables enumerated over genotypes, phenotypes and sex, against a plain reading of the rules."""

import itertools

import pytest

from helixloom.functions import vocab as V
from helixloom.operators import inheritance as I

CHILD = ["0/0", "0|0", "0/1", "1|0", "1/0", "1/1", "1|1", "1", "0", "./1", ".|1", "1|.", None]
PARENT = ["0/0", "0/1", "1/1", "0", "1", "./1", "0|0", None]


def expect(row):
    chrom, pos, gt, f, m, fp, mp, sex, ph, lof = row
    het, ref, alt, xref = V.HET, V.HOM_REF, V.HOM_ALT, V.X_REF
    out = set()
    if chrom not in ("X", "Y"):
        healthy = fp == "1" and mp == "1"
        if ph == "2" and gt in alt and healthy and f in het and m in het and lof:
            out.add("autosomal_recessive")
        if ph == "2" and gt in het and healthy and f in ref and m in ref:
            out.add("denovo")
        if ph == "2" and gt in het and not (fp == "2" and mp == "2"):
            if (mp == "2" and m in het and f in ref) or (fp == "2" and f in het and m in ref):
                out.add("autosomal_dominant")
    if chrom == "X" and not any(lo < pos < hi for lo, hi in V.PAR["hg19"]) and ph == "2":
        from_mother = m in het and mp == "2" and f in xref and fp == "1"
        from_father = m in ref and mp == "1" and f in V.X_FATHER_CARRIER and fp == "2"
        if (sex == "1" and gt in V.X_MALE_DOMINANT and from_mother) or (sex == "2" and gt in het and (from_mother or from_father)):
            out.add("x_linked_dominant")
        if lof and m in het and mp == "1":
            if (sex == "1" and gt not in xref) or (sex == "2" and gt in alt and f in V.X_FATHER_CARRIER and fp == "2"):
                out.add("x_linked_recessive")
        if fp == "1" and mp == "1" and f in xref and m in xref:
            if (sex == "1" and gt in V.X_MALE_DENOVO) or (sex == "2" and gt in het):
                out.add("x_linked_denovo")
    return out


def test_row_modes_exhaustively(spark):
    rows = [r for r in itertools.product(
        ["1", "X", "Y"], [60001, 100000, 2699520], CHILD, PARENT, PARENT, ["1", "2", None], ["1", "2", None], ["1", "2"], ["1", "2"], [True, False])
        if not (r[0] != "X" and r[1] != 60001)]
    names = ["CHROM", "POS", "GT", "Father_Genotype", "Mother_Genotype", "Father_Phenotype", "Mother_Phenotype", "Sex", "Phenotype", "lof"]
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(rows, columns=names).astype({"POS": "int32"}),
                               "CHROM string, POS int, GT string, Father_Genotype string, Mother_Genotype string, Father_Phenotype string, "
                               "Mother_Phenotype string, Sex string, Phenotype string, lof boolean")
    df = df.withColumn("variant_key", df["POS"]).withColumn("Sample_ID", df["Sex"])
    for r in I.tag_modes(df).collect():
        assert set(r["mendelian_diseases"]) == expect(tuple(r[n] for n in names)), r


def compound(spark, rows):
    names = "variant_key string, CHROM string, POS int, Sample_ID string, GT string, Father_Genotype string, Mother_Genotype string, Father_Phenotype string, Mother_Phenotype string, Phenotype string"
    df = spark.createDataFrame([(v, "1", 1, c, gt, f, m, "1", "1", "2") for v, c, gt, f, m in rows], names)
    genes = spark.createDataFrame([(v, g) for v, _, _, _, _ in rows for g in (v[0],)], "variant_key string, gene string")
    return sorted((r["variant_key"], r["Sample_ID"]) for r in I.compound_het(df, genes).collect())


def test_compound_het_needs_both_origins(spark):
    rows = [("a1", "c", "0/1", "0/1", "0/0"), ("a2", "c", "0|1", "0|0", "1|0"), ("a3", "c", "0/1", "0/1", "0/0"),  # mixed spellings pair up
            ("b1", "c", "0/1", "0/1", "0/0"), ("b2", "c", "0/1", "0/1", "0/0"),  # paternal only
            ("a4", "d", "0/1", "0/0", "0/1"),  # other child, maternal only
            ("a5", "c", "0/1", "0/1", "0/1"), ("a6", "c", "1/1", "0/1", "0/0")]
    assert compound(spark, rows) == [("a1", "c"), ("a2", "c"), ("a3", "c")]


def test_tag_is_idempotent(spark):
    names = "variant_key int, CHROM string, POS int, Sample_ID string, GT string, Father_Genotype string, Mother_Genotype string, Father_Phenotype string, Mother_Phenotype string, Phenotype string, Sex string, lof boolean"
    df = spark.createDataFrame([(1, "1", 5, "c", "0/1", "0/0", "0/0", "1", "1", "2", "1", True)], names)
    once = I.tag_modes(df)
    assert I.tag_modes(once).collect() == once.collect()
    assert once.first()["mendelian_diseases"] == ["denovo"]


def test_strict_denovo_refuses_phased_parents(spark):
    names = "CHROM string, GT string, Father_Genotype string, Mother_Genotype string, Father_Phenotype string, Mother_Phenotype string, Phenotype string"
    df = spark.createDataFrame([("1", "0/1", "0|0", "0/0", "1", "1", "2")], names)
    assert df.filter(I.denovo()).count() == 1 and df.filter(I.denovo(strict=True)).count() == 0


def test_par_by_assembly(spark):
    df = spark.createDataFrame([("X", p) for p in (10001, 60001, 60002, 2699520, 2781479, 154931045, 155701384)] + [("1", 5)], "CHROM string, POS int")
    assert sorted(r["POS"] for r in df.filter(I.outside_par("hg19")).collect()) == [10001, 60001, 2699520, 2781479, 155701384]
    assert sorted(r["POS"] for r in df.filter(I.outside_par("hg38")).collect()) == [10001, 2781479, 154931045]


@pytest.mark.parametrize("n,want", [(0, 3), (1, 2), (2, 0)])
def test_kindred(spark, n, want):
    df = spark.createDataFrame([("v1", "f1"), ("v1", "f2"), ("v2", "f1")], "variant_key string, Family_ID string")
    assert I.kindred(df, n).count() == want


def test_compound_tag_is_decided_by_the_rows_own_genes(spark):
    """Two rows of one variant and child with different genes: only the row whose gene qualifies is tagged."""
    row = lambda v, pos, mother, father, genes: (v, "1", pos, "kid", "0/1", father, mother, "1", "1", "2", True, genes)
    names = "variant_key int, CHROM string, POS int, Sample_ID string, GT string, Father_Genotype string, Mother_Genotype string, Father_Phenotype string, Mother_Phenotype string, Phenotype string, lof boolean, genes array<string>"
    g = spark.createDataFrame([row(1, 10, "0/1", "0/0", ["A"]), row(1, 10, "0/1", "0/0", ["B"]), row(2, 20, "0/0", "0/1", ["A"])], names).withColumn("Sex", F.lit("1"))
    tagged = [(r["variant_key"], r["genes"]) for r in I.tag_modes(g, "genes").collect() if "compound_heterozygous" in r["mendelian_diseases"]]
    assert sorted(tagged) == [(1, ["A"]), (2, ["A"])]
    table = spark.createDataFrame([(1, "A"), (2, "A")], "variant_key int, gene string")
    assert sum("compound_heterozygous" in r["mendelian_diseases"] for r in I.tag_modes(g, table).collect()) == 3

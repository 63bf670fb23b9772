"""Inputs of the registered queries, derived from the given tables by arithmetic that SQL repeats.

Documents: orders with their line items. Cohort: every part is a variant seen in five trios.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.functions import vocab as V
from helixloom.operators.sizing import parts_for, spread
from helixloom.sources.warehouse import Tables

# The five trios: family, child sex, phenotypes of child, father, mother.
TRIOS = [(1, "1", "2", "1", "1"), (2, "2", "2", "2", "1"), (3, "1", "2", "1", "2"), (4, "2", "2", "1", "1"), (5, "2", "2", "1", "2")]
ALLELES = ["0/0", "0/1", "1|0", "1/1", "0|0"]
CHROMS = ["1", "2", "X", "Y", "X", "7"]
BASES = ["A", "C", "G", "T"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- documents ---------------------------------------------------------------------------

def order_tables(spark: SparkSession, sf: str) -> Tables:
    """Orders as documents, line items and their parts as element tables."""
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return Tables(table(spark, sf, "orders"), {"line": lines}, "o_orderkey")


LINE_FIELDS = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def nested_orders(spark: SparkSession, sf: str, fields: list[str] | None = None) -> DataFrame:
    """The array layout of the same documents."""
    from helixloom.operators.nesting import nest

    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    wanted = fields or LINE_FIELDS
    met = lines.select("o_orderkey", *wanted).repartition(parts_for(orders, lines), "o_orderkey")
    return orders.join(nest(met, ["o_orderkey"], "line", wanted), "o_orderkey", "left")


# --- cohort ------------------------------------------------------------------------------

def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.lit(values), (index + 1).cast("int"))


def variants(spark: SparkSession, sf: str) -> DataFrame:
    """One variant per part: key, position, alleles, gene and a loss-of-function flag."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("variant_key"), _pick(CHROMS, k % 6).alias("CHROM"), (k * 20000).alias("POS"),
        _pick(BASES, k % 4).alias("REF"), _pick(BASES, (k + 1 + k % 3) % 4).alias("ALT"),
        F.col("p_brand").alias("gene"), ((k / 6).cast("long") % 3 != 0).alias("lof"), F.col("p_size").alias("p_size"),
        F.col("p_retailprice").alias("p_retailprice"), F.col("p_type").alias("p_type"))


def _gt(k: Column, role: str, fam: Column | int) -> Column:
    fam = F.lit(fam) if isinstance(fam, int) else fam
    index = {
        "child": (F.floor(k / 6) + 7 * fam) % 5,
        "father": (F.floor(k / 30) + 3 * fam) % 5,
        "mother": (F.floor(k / 150) + fam) % 5,
    }[role]
    return _pick(ALLELES, index)


def pedigree(spark: SparkSession) -> DataFrame:
    """The five trios; each affected child of family 4 lists its cousin's ids as siblings."""
    rows = []
    for fam, sex, child, father, mother in TRIOS:
        sibs = "'F2C,F1C'" if fam == 4 else "NULL"
        unaffected = "'F1F,F1M'" if fam == 4 else "NULL"
        rows.append(f"('family{fam}','F{fam}C','F{fam}F','F{fam}M','{sex}','{child}',NULL,{sibs},NULL,NULL,{unaffected},NULL,NULL)")
        rows.append(f"('family{fam}','F{fam}F',NULL,NULL,'1','{father}',NULL,NULL,NULL,NULL,NULL,NULL,NULL)")
        rows.append(f"('family{fam}','F{fam}M',NULL,NULL,'2','{mother}',NULL,NULL,NULL,NULL,NULL,NULL,NULL)")
    names = ", ".join(V.PED_COLUMNS)
    typed = ", ".join(f"cast({c} AS string) AS {c}" for c in V.PED_COLUMNS)
    return spark.sql(f"SELECT {typed} FROM VALUES {', '.join(rows)} AS t({names})")


SAMPLES = [f"F{fam}{role}" for fam, *_ in TRIOS for role in "CFM"]


def calls(k: Column) -> Column:
    """Sample columns of one variant, in heading order: GT:AD:DP:GQ."""
    names = {"C": "child", "F": "father", "M": "mother"}
    cells = []
    for s in SAMPLES:
        gt = _gt(k, names[s[2]], int(s[1]))
        depth = F.concat((k % 50 + 10).cast("string"), F.lit(","), (k % 30 + int(s[1])).cast("string"))
        cells.append(F.concat(gt, F.lit(":"), depth, F.lit(":"), (k % 80 + 10).cast("string"), F.lit(":"), (k % 99).cast("string")))
    return F.array(*cells)


def genotypes(spark: SparkSession, sf: str) -> DataFrame:
    """Genotype rows of the whole cohort, one per variant and sample."""
    k = F.col("variant_key")
    return spread(variants(spark, sf)).select(
        "variant_key", F.explode(F.arrays_zip(F.lit(SAMPLES).alias("Sample_ID"), calls(k).alias("call"))).alias("s")
    ).select("variant_key", "s.Sample_ID", F.split_part("s.call", F.lit(":"), F.lit(1)).alias("GT"))


def trio_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Children's genotype rows that already carry family data, without any join: the shape the
    inheritance rules read once genotypes have been enriched and stored."""
    k = F.col("variant_key")
    fams = F.explode(F.array(*[F.struct(F.lit(f).alias("fam"), F.lit(s).alias("Sex"), F.lit(c).alias("Phenotype"),
                                        F.lit(fp).alias("Father_Phenotype"), F.lit(mp).alias("Mother_Phenotype"))
                               for f, s, c, fp, mp in TRIOS])).alias("f")
    rows = spread(variants(spark, sf)).select("variant_key", "CHROM", "POS", "gene", "lof", fams).select(
        "variant_key", "CHROM", "POS", "gene", "lof", "f.*")
    return rows.select(
        "variant_key", "CHROM", "POS", "lof", F.when(F.col("lof"), F.array("gene")).alias("genes"), F.concat(F.lit("F"), F.col("fam"), F.lit("C")).alias("Sample_ID"),
        F.concat(F.lit("family"), F.col("fam")).alias("Family_ID"), "Sex", "Phenotype", "Father_Phenotype", "Mother_Phenotype",
        _gt(k, "child", F.col("fam")).alias("GT"), _gt(k, "father", F.col("fam")).alias("Father_Genotype"),
        _gt(k, "mother", F.col("fam")).alias("Mother_Genotype"))


def gene_table(spark: SparkSession, sf: str) -> DataFrame:
    """Genes in which a variant is loss-of-function."""
    return variants(spark, sf).filter("lof").select("variant_key", "gene")


# --- the same in SQL ---------------------------------------------------------------------

_ALLELES_SQL = "['0/0','0/1','1|0','1/1','0|0']"
VARIANTS_SQL = """SELECT p_partkey AS variant_key, (['1','2','X','Y','X','7'])[(p_partkey % 6 + 1)::INT] AS "CHROM",
 (p_partkey*20000)::INT AS "POS", (['A','C','G','T'])[(p_partkey % 4 + 1)::INT] AS "REF",
 (['A','C','G','T'])[((p_partkey + 1 + p_partkey % 3) % 4 + 1)::INT] AS "ALT", p_brand AS gene,
 (p_partkey // 6) % 3 <> 0 AS lof, p_size, p_retailprice, p_type FROM part"""
FAMILIES_SQL = """SELECT * FROM (VALUES (1,'1','2','1','1'),(2,'2','2','2','1'),(3,'1','2','1','2'),(4,'2','2','1','1'),(5,'2','2','1','2'))
 AS t(fam, "Sex", "Phenotype", "Father_Phenotype", "Mother_Phenotype")"""
COHORT_SQL = f"""v AS ({VARIANTS_SQL}), fams AS ({FAMILIES_SQL}),
 trio AS (SELECT variant_key, "CHROM", "POS", gene, lof, 'F' || fam || 'C' AS "Sample_ID", 'family' || fam AS "Family_ID", fam, "Sex",
 "Phenotype", "Father_Phenotype", "Mother_Phenotype",
 ({_ALLELES_SQL})[((variant_key // 6 + 7*fam) % 5 + 1)::INT] AS "GT",
 ({_ALLELES_SQL})[((variant_key // 30 + 3*fam) % 5 + 1)::INT] AS "Father_Genotype",
 ({_ALLELES_SQL})[((variant_key // 150 + fam) % 5 + 1)::INT] AS "Mother_Genotype" FROM v, fams),
 gts AS (SELECT variant_key, 'F' || fam || 'C' AS "Sample_ID", "GT" FROM trio
 UNION ALL SELECT variant_key, 'F' || fam || 'F', "Father_Genotype" FROM trio
 UNION ALL SELECT variant_key, 'F' || fam || 'M', "Mother_Genotype" FROM trio)"""

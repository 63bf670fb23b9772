"""Lines of several alternate alleles, written from the part table: one, two or three by the part's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.operators.alleles import unreadable_values
from helixloom.operators.info import with_info
from helixloom.plans.load import load_vcf
from helixloom.sources.vcf import ingest_report, read_catalog, read_vcf
from workloads import derive as D
from workloads.registry import query
from workloads.storage import write_vcf

HEADER = [
    "##fileformat=VCFv4.2",
    *[f'##INFO=<ID={n},Number={c},Type={t},Description="Derived">' for n, c, t in (("AC", "A", "Integer"), ("AF", "A", "Float"), ("DPR", "R", "Integer"), ("LK", "G", "Integer"), ("MQ", "1", "Float"))],
    *[f'##FORMAT=<ID={n},Number={c},Type={t},Description="Derived">' for n, c, t in (("GT", "1", "String"), ("AD", "R", "Integer"), ("PL", "G", "Integer"))],
    "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "S1"]),
]


def _file(spark: SparkSession, sf: str) -> str:
    """Part k has k % 3 + 1 alleles. Every seventh has a first AC that is no number, every eleventh a bad MQ."""
    k = D.table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("k")).withColumn("n", F.expr("cast(k % 3 + 1 as int)"))

    def many(last: str, value: str) -> str:
        return f"array_join(transform(sequence(0, {last}), i -> cast({value} as string)), ',')"

    info = F.concat_ws(
        ";", F.expr(f"concat('AC=', {many('n - 1', 'case when k % 7 = 0 and i = 0 then string(chr(120)) else string(k % 9 + i) end')})"),
        F.expr(f"concat('AF=', {many('n - 1', 'concat(string(0), chr(46), string((k + i) % 10))')})"), F.expr(f"concat('DPR=', {many('n', 'k % 50 + i')})"),
        F.expr(f"concat('LK=', {many('int((n + 1) * (n + 2) / 2) - 1', 'k % 5 + i')})"), F.expr("concat('MQ=', if(k % 11 = 0, '1,2', string(k % 60)))"))
    call = F.concat_ws(":", F.expr("element_at(array('0/1', '1/2', '2|3'), n)"), F.expr(many("n", "i + 10")), F.expr(many("int((n + 1) * (n + 2) / 2) - 1", "i + 20")))
    return write_vcf(spark, HEADER, k.select(F.concat_ws(
        "\t", F.lit("1"), F.expr("string(k * 10)"), F.lit("."), F.lit("A"), F.expr("element_at(array('C', 'C,G', 'C,G,T'), n)"), F.lit("50"), F.lit("PASS"), info, F.lit("GT:AD:PL"), call).alias("value")), 2)


def _joined(column: str):
    return F.array_join(F.transform(column, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",")


_V = "v AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_partkey % 3 + 1 AS BIGINT) AS n FROM part)"
_AC = "CASE WHEN k % 7 = 0 AND i = 0 THEN NULL ELSE k % 9 + i END"


@query("allele_vectors", f"""WITH {_V} SELECT k, CASE WHEN n = 1 AND k % 7 <> 0 THEN k % 9 END AS "AC", CASE WHEN n = 1 THEN (k % 10) / 10.0::DOUBLE END AS "AF",
 (SELECT string_agg(coalesce(CAST({_AC} AS VARCHAR), '-'), ',' ORDER BY i) FROM range(n) r(i)) AS acs, (SELECT string_agg(CAST(((k + i) % 10) / 10.0::DOUBLE AS VARCHAR), ',' ORDER BY i) FROM range(n) r(i)) AS afs,
 (SELECT string_agg(CAST(k % 50 + i AS VARCHAR), ',' ORDER BY i) FROM range(n + 1) r(i)) AS dpr, (SELECT string_agg(CAST(k % 5 + i AS VARCHAR), ',' ORDER BY i) FROM range((n + 1) * (n + 2) // 2) r(i)) AS lk FROM v""")
def allele_vectors(spark: SparkSession, sf: str) -> DataFrame:
    tables, _ = load_vcf(spark, _file(spark, sf), profile=False)
    return tables.base.select((F.col("POS") / 10).cast("long").alias("k"), "AC", "AF", _joined("AC_by_allele").alias("acs"), _joined("AF_by_allele").alias("afs"),
                              _joined("DPR_by_allele").alias("dpr"), _joined("LK_by_allele").alias("lk"))


# Of 2|3 the first allele is absent, so no genotype of it is kept.
@query("split_multi_allelic", f"""WITH {_V}, a AS (SELECT k, n, unnest(range(n)) AS i FROM v)
 SELECT k, substr('CGT', i + 1, 1) AS "ALT", {_AC} AS "AC", ((k + i) % 10) / 10.0::DOUBLE AS "AF", (k % 50) || ',' || (k % 50 + i + 1) AS dpr,
  (k % 5) || ',' || (k % 5 + (i + 1) * (i + 2) // 2) || ',' || (k % 5 + (i + 1) * (i + 2) // 2 + i + 1) AS lk,
  CASE WHEN n < 3 THEN '0/1' WHEN i = 1 THEN '1|0' WHEN i = 2 THEN '0|1' END AS "GT", CASE WHEN n < 3 OR i > 0 THEN 10 END AS "AD_ref", CASE WHEN n < 3 OR i > 0 THEN 11 + i END AS "AD_alt",
  CASE WHEN n < 3 OR i > 0 THEN '20,' || (20 + (i + 1) * (i + 2) // 2) || ',' || (20 + (i + 1) * (i + 2) // 2 + i + 1) END AS "PL" FROM a""")
def split_multi_allelic(spark: SparkSession, sf: str) -> DataFrame:
    tables, _ = load_vcf(spark, _file(spark, sf), profile=False, split=True)
    called = tables.paths["sample"].select("variant_key", "GT", "AD_ref", "AD_alt", "PL")
    return tables.base.join(called, "variant_key", "left").select(
        (F.col("POS") / 10).cast("long").alias("k"), "ALT", "AC", "AF", _joined("DPR_by_allele").alias("dpr"), _joined("LK_by_allele").alias("lk"), "GT", "AD_ref", "AD_alt", "PL")


_UNREADABLE = f"""WITH {_V} SELECT 'AC' AS name, sum(n)::BIGINT AS "values", count(*) FILTER (k % 7 = 0) AS unreadable FROM v UNION ALL SELECT 'AF', sum(n)::BIGINT, 0 FROM v
 UNION ALL SELECT 'DPR', sum(n + 1)::BIGINT, 0 FROM v UNION ALL SELECT 'LK', sum((n + 1) * (n + 2) // 2)::BIGINT, 0 FROM v UNION ALL SELECT 'MQ', count(*), count(*) FILTER (k % 11 = 0) FROM v"""


@query("unreadable_values", _UNREADABLE)
def unreadable(spark: SparkSession, sf: str) -> DataFrame:
    path = _file(spark, sf)
    catalog = read_catalog(spark, path)
    return unreadable_values(with_info(read_vcf(spark, path)), catalog.info, catalog.info_numbers)


@query("ingest_report_unreadable", f"""SELECT (SELECT count(*) FROM part) AS processed, sum(unreadable)::BIGINT AS unreadable FROM ({_UNREADABLE})""")
def report(spark: SparkSession, sf: str) -> DataFrame:
    path = _file(spark, sf)
    return ingest_report(read_vcf(spark, path), catalog=read_catalog(spark, path)).select("processed", "unreadable")

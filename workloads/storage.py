"""Loads and sinks: files written under the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.operators.otu import otu_table, sample_ids
from helixloom.operators.shaping import safe_names
from helixloom.operators.sizing import shared_folder
from helixloom.plans import log as L
from helixloom.plans.field_plan import schema_catalog
from helixloom.plans.load import add_run, labelled_run, load_case_control, load_vcf, publish_run
from helixloom.plans.spec import Attribute, FieldFilter, QuerySpec, run_spec
from helixloom.sources.export import export_csv, export_otu_csv
from helixloom.sources.vcf import collect_catalog, region
from helixloom.sources.warehouse import Tables, get_variant, read_tables, warehouse_schema, write_tables
from workloads import derive as D
from workloads import vcf_text as T
from workloads.family import COMPOUND_CTE, RULES, _TAGGED
from workloads.registry import query
from workloads.search import _SPEC_SQL, SPEC

HEADER = [
    "##fileformat=VCFv4.2",
    *[f'##INFO=<ID={n},Number=1,Type={t},Description="Derived">' for n, t in
      (("AC", "Integer"), ("AF", "Float"), ("AN", "Integer"), ("DP", "Integer"), ("NOVEL", "Flag"), ("Note", "String"), ("vqs_score", "String"))],
    '##INFO=<ID=CSQ,Number=.,Type=String,Description="Consequence annotations from Ensembl VEP. Format: ' + "|".join(T.CSQ_FIELDS) + '">',
    *[f'##FORMAT=<ID={n},Number=1,Type={t},Description="Derived">' for n, t in (("GT", "String"), ("AD", "Integer"), ("DP", "Integer"), ("GQ", "Integer"))],
    "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *D.SAMPLES]),
]


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def vcf_files(spark: SparkSession, sf: str, broken: bool = False) -> str:
    """The cohort as several VCF text files, each with its header."""
    return write_vcf(spark, HEADER, T.lines(spark, sf, broken), 3)


def write_vcf(spark: SparkSession, header: list[str], lines: DataFrame, files: int = 1) -> str:
    """Lines dealt out over files of one folder, below the header in each."""
    root = folder(spark, "vcf")
    top = spark.createDataFrame([(p, i, x) for p in range(files) for i, x in enumerate(header)], "part int, place long, value string")
    rows = lines.select(F.pmod(F.xxhash64("value"), F.lit(files)).cast("int").alias("part"), F.lit(len(header)).cast("long").alias("place"), "value")
    every = top.unionByName(rows).repartition(files, "part").sortWithinPartitions("part", "place").select("part", "value")
    every.write.partitionBy("part").text(root, compression="gzip" if files == 1 else "none")
    return f"{root}/part=*"


# In the text a variant is loss-of-function through its second transcript, whose gene has a suffix.
_TEXT_COHORT = D.COHORT_SQL.replace("(p_partkey // 6) % 3 <> 0 AS lof", "p_partkey % 3 = 0 AS lof").replace("p_brand AS gene", "p_brand || 'b' AS gene")
_LOADED = f"WITH {_TEXT_COHORT}, {COMPOUND_CTE}, tags AS ({_TAGGED})"


@query("load_vcf_modes", f"""{_LOADED} SELECT variant_key AS k, "Sample_ID", mode FROM tags""")
def _(spark, sf):
    tables, _ = load_vcf(spark, vcf_files(spark, sf), D.pedigree(spark), plain_chrom=True)
    tagged = tables.paths["sample"].select((F.col("POS") / 20000).cast("long").alias("k"), "Sample_ID", F.explode("mendelian_diseases").alias("mode"))
    return tagged


@query("load_vcf_tables", f"""WITH {_TEXT_COHORT}, s AS (SELECT 'sample' AS path, count(*) AS n FROM gts), c AS (SELECT 'CSQ_nested', 2 * count(*) FROM v), b AS (SELECT 'variants', count(*) FROM v)
 SELECT * FROM s UNION ALL SELECT * FROM c UNION ALL SELECT * FROM b""")
def _(spark, sf):
    tables, _ = load_vcf(spark, vcf_files(spark, sf), D.pedigree(spark), plain_chrom=True)
    counted = [df.agg(F.lit(p).alias("path"), F.count(F.lit(1)).alias("n")) for p, df in [("variants", tables.base), *tables.paths.items()]]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out.select("path", "n")


@query("load_vcf_rejects", """SELECT reason, count(*) AS n FROM (SELECT CASE p_partkey % 50 WHEN 1 THEN 'POS is not a number' WHEN 2 THEN 'QUAL is not a number'
 WHEN 4 THEN 'fewer than 8 columns' END AS reason FROM part) WHERE reason IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    _, bad = load_vcf(spark, vcf_files(spark, sf, broken=True), profile=False, stage=False)
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# Small cohorts of their own samples, derived from the part table.
_TEXT = ["##fileformat=VCFv4.2", '##INFO=<ID=AC,Number=1,Type=Integer,Description="Derived">', '##INFO=<ID=DP,Number=1,Type=Integer,Description="Derived">',
         '##INFO=<ID=Dp_Mean,Number=1,Type=Float,Description="Derived">', '##INFO=<ID=DP_MEAN,Number=1,Type=Float,Description="Derived">',
         '##INFO=<ID=LOF,Number=.,Type=String,Description="Predicted loss of function. Format: \'Gene_Name | Gene_ID | Number_of_transcripts_in_gene | Percent_of_transcripts_affected\'">',
         '##FORMAT=<ID=GT,Number=1,Type=String,Description="Derived">']


def _heading(*samples: str) -> list[str]:
    return [*_TEXT, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def _cohort_lines(spark: SparkSession, sf: str, which: str, calls: list, chrom: str = "chr1", ac: str = "k % 9", ident: str = "'.'") -> DataFrame:
    k = D.table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("k")).filter(which)
    info = F.format_string("AC=%d;DP=%d;Dp_Mean=1.5;DP_MEAN=2.5;LOF=(G%d|E|3|0.5)", F.expr(ac), F.expr("k % 50"), F.expr("k % 7"))
    return k.select(F.concat_ws("\t", F.lit(chrom), F.expr("k * 10").cast("string"), F.expr(ident), F.lit("A"), F.lit("C"), F.lit("50"), F.lit("PASS"), info, F.lit("GT"), *[F.expr(c) for c in calls]).alias("value"))


_GT = "CASE k % 3 WHEN 0 THEN '0/1' WHEN 1 THEN '1/1' ELSE '0/0' END"


@query("load_files_of_other_samples", """WITH v AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN '0/1' WHEN 1 THEN '1/1' ELSE '0/0' END AS g FROM part),
 c AS (SELECT k, unnest(CASE WHEN k % 2 = 0 THEN ['S1', 'S2'] ELSE ['S9', 'S2', 'S7'] END) AS "Sample_ID",
  unnest(CASE WHEN k % 2 = 0 THEN [g, '0/1'] ELSE ['1/1', g, '0/0'] END) AS "GT" FROM v) SELECT k, "Sample_ID", "GT" FROM c WHERE "GT" <> '0/0'""")
def _(spark, sf):
    # Two files with other samples in another order: every call stays with its own sample.
    a = write_vcf(spark, _heading("S1", "S2"), _cohort_lines(spark, sf, "k % 2 = 0", [_GT, "'0/1'"]))
    b = write_vcf(spark, _heading("S9", "S2", "S7"), _cohort_lines(spark, sf, "k % 2 = 1", ["'1/1'", _GT, "'0/0'"]))
    root = a.rsplit("/", 2)[0]
    tables, _ = load_vcf(spark, f"{root}/{{{a.split('/')[-2]},{b.split('/')[-2]}}}/part=*", profile=False)
    return tables.paths["sample"].select((F.col("POS") / 10).cast("long").alias("k"), "Sample_ID", "GT")


@query("load_ragged_lines", """SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'number of calls differs from the heading' END AS reason FROM part""")
def _(spark, sf):
    path = write_vcf(spark, _heading("S1", "S2"), _cohort_lines(spark, sf, "k % 5 <> 0", [_GT, "'0/1'"]).union(_cohort_lines(spark, sf, "k % 5 = 0", [_GT])), 2)
    tables, bad = load_vcf(spark, path, profile=False)
    k = (F.split("line", "\t")[1].cast("long") / 10).cast("long").alias("k")
    return tables.base.select((F.col("POS") / 10).cast("long").alias("k"), F.lit(None).cast("string").alias("reason")).unionByName(bad.select(k, "reason"))


@query("load_names_that_differ_in_case", """SELECT p_partkey AS k, '1' AS "CHROM", 1.5::DOUBLE AS low, 2.5::DOUBLE AS high, 'G' || (p_partkey % 7) AS gene, 3 AS transcripts, false AS flag FROM part""")
def _(spark, sf):
    # LOF of one annotator beside the load's own flag, two fields alike but for case, chr1 read as 1.
    tables, _ = load_vcf(spark, write_vcf(spark, _heading("S1"), _cohort_lines(spark, sf, "true", ["'0/1'"])), profile=False)
    base = tables.base.select("variant_key", (F.col("POS") / 10).cast("long").alias("k"), "CHROM", F.col("Dp_Mean").alias("low"), F.col("DP_MEAN_2").alias("high"), F.col("loss_of_function").alias("flag"))
    lof = tables.paths["LOF"].select("variant_key", F.col("LOF_Gene_Name").alias("gene"), F.col("LOF_Number_of_transcripts_in_gene").cast("int").alias("transcripts"))
    return base.join(lof, "variant_key").drop("variant_key")


_CASES = """v AS (SELECT p_partkey AS k, p_partkey % 2 = 0 OR p_partkey % 5 = 0 AS c, p_partkey % 2 = 1 AS o FROM part)"""


@query("load_case_control", f"""WITH {_CASES} SELECT k, CASE WHEN c THEN k % 9 END AS "AC_case", CASE WHEN o THEN k % 4 END AS "AC_control",
 (CASE WHEN c THEN 1 ELSE 0 END + CASE WHEN o THEN 1 ELSE 0 END) AS calls, concat_ws(',', CASE WHEN c THEN 'case' END, CASE WHEN o THEN 'control' END) AS groups FROM v WHERE c OR o""")
def _(spark, sf):
    # Shared and single variants, and cases whose lines stand twice in the file.
    case = _cohort_lines(spark, sf, "k % 2 = 0 OR k % 5 = 0", ["'0/1'"])
    tables, _ = load_case_control(spark, write_vcf(spark, _heading("C1"), case.union(case), 2),
                                  write_vcf(spark, _heading("K1"), _cohort_lines(spark, sf, "k % 2 = 1", ["'1/1'"], "1", "k % 4")), profile=False)
    called = tables.paths["sample"].groupBy("variant_key").agg(F.count(F.lit(1)).alias("calls"), F.array_join(F.array_sort(F.collect_set("group")), ",").alias("groups"))
    return tables.base.join(called, "variant_key").select((F.col("POS") / 10).cast("long").alias("k"), "AC_case", "AC_control", "calls", "groups")


@query("add_labelled_run", f"""WITH {_CASES} SELECT k, CASE WHEN c THEN k % 9 END AS "AC_r1", CASE WHEN o THEN k % 4 END AS "AC_r2",
 concat_ws(',', CASE WHEN c THEN 'r1=' || (k % 50) END, CASE WHEN o THEN 'r2=' || (k % 50) END) AS depths, concat_ws(',', CASE WHEN c THEN 'C1' END, CASE WHEN o THEN 'K1' END) AS samples FROM v WHERE c OR o""")
def _(spark, sf):
    first, _ = load_vcf(spark, write_vcf(spark, _heading("C1"), _cohort_lines(spark, sf, "k % 2 = 0 OR k % 5 = 0", ["'0/1'"])), profile=False)
    second, _ = load_vcf(spark, write_vcf(spark, _heading("K1"), _cohort_lines(spark, sf, "k % 2 = 1", ["'1/1'"], "1", "k % 4")), profile=False)
    old, new = folder(spark, "version"), folder(spark, "version")
    write_tables(labelled_run(first, "r1", ["DP"]), old)
    tables = add_run(spark, old, new, second, "r2", ["DP"])
    called = tables.paths["sample"].groupBy("variant_key").agg(F.array_join(F.array_sort(F.collect_set("Sample_ID")), ",").alias("samples"))
    depths = F.array_join(F.array_sort(F.transform("DP", lambda e: F.concat(e["DP_label"], F.lit("="), e["DP_value"].cast("string")))), ",")
    return tables.base.join(called, "variant_key").select((F.col("POS") / 10).cast("long").alias("k"), "AC_r1", "AC_r2", depths.alias("depths"), "samples")


@query("search_stored_tables", f"""WITH {D.COHORT_SQL} SELECT variant_key, "POS", "Sample_ID", "GT" FROM trio WHERE "CHROM" = '7' AND "POS" >= 2000000 AND "GT" = '0/1'""")
def _(spark, sf):
    spec = QuerySpec([Attribute("POS"), Attribute("Sample_ID", "sample"), Attribute("GT", "sample")], [
        FieldFilter("filter_term", "CHROM", "7"), FieldFilter("filter_range_gte", "POS", "2000000"), FieldFilter("nested_filter_term", "GT", "0/1", path="sample")])
    return run_spec(_stored(spark, sf), spec)


def _stored(spark: SparkSession, sf: str) -> Tables:
    """The derived cohort written as a warehouse and read back."""
    base = D.variants(spark, sf).select("variant_key", "CHROM", "POS", "gene", "p_size")
    rows = D.trio_rows(spark, sf).select("variant_key", "CHROM", "POS", "Sample_ID", "GT")
    root = folder(spark, "warehouse")
    write_tables(Tables(base, {"sample": rows}), root)
    return read_tables(spark, root, ["sample"])


@query("warehouse_region", f"""WITH {D.COHORT_SQL} SELECT variant_key, "POS", "Sample_ID", "GT" FROM trio WHERE "CHROM" = '7' AND "POS" BETWEEN 2000000 AND 20000000""")
def _(spark, sf):
    return region(_stored(spark, sf).paths["sample"], "7", 2_000_000, 20_000_000).select("variant_key", "POS", "Sample_ID", "GT")


@query("warehouse_document", f"""WITH v AS ({D.VARIANTS_SQL}) SELECT variant_key, "CHROM", "POS", gene FROM v WHERE variant_key = 17""")
def _(spark, sf):
    return get_variant(_stored(spark, sf).base, 17).select("variant_key", "CHROM", "POS", "gene")


@query("warehouse_schema", """SELECT field, path, type FROM (SELECT DISTINCT replace(p_brand, '#', '_') AS field, NULL::VARCHAR AS path, 'integer' AS type FROM part
 UNION ALL SELECT DISTINCT p_type || '_score', NULL, 'float' FROM part UNION ALL SELECT 'PL' || r_regionkey, 'sample', 'integer' FROM region
 UNION ALL SELECT unnest(['AC_case', 'AC_control']), NULL, 'integer')""")
def _(spark, sf):
    catalog = collect_catalog(T.header(spark, sf))
    catalog.info["AC"] = "integer"
    fields = schema_catalog(warehouse_schema(catalog, case_control=True))
    core = {"Variant", "CHROM", "POS", "ID", "REF", "ALT", "VariantType", "dbSNP_ID", "COSMIC_ID", "QUAL_case", "QUAL_control", "FILTER_case", "FILTER_control", "Sample_ID", "group"}
    return spark.createDataFrame([f for f in fields if f[0] not in core], "field string, path string, type string")


@query("export_csv", """SELECT p_partkey::VARCHAR AS "Part", coalesce(nullif(p_type, 'PROMO'), 'None') AS p_type, p_size::VARCHAR AS p_size FROM part""")
def _(spark, sf):
    out = folder(spark, "csv")
    export_csv(D.table(spark, sf, "part").select("p_partkey", F.nullif("p_type", F.lit("PROMO")).alias("p_type"), "p_size"), out, {"p_partkey": "Part"})
    return spark.read.csv(out, header=True)


@query("export_otu_csv", """SELECT 'OTU_' || (row_number() OVER (ORDER BY t) - 1) AS "#OTU ID", a::DOUBLE::VARCHAR AS s1, b::DOUBLE::VARCHAR AS s2, t AS taxonomy
 FROM (SELECT p_type AS t, coalesce(sum(p_size) FILTER (p_partkey % 2 = 0), 0) AS a, coalesce(sum(p_size) FILTER (p_partkey % 2 = 1), 0) AS b FROM part GROUP BY 1)""")
def _(spark, sf):
    rows = D.table(spark, sf, "part").select(F.col("p_type").alias("taxonomy"), F.when(F.col("p_partkey") % 2 == 0, "s1").otherwise("s2").alias("BMlabid"), F.col("p_size").cast("double").alias("value"))
    out = folder(spark, "csv")
    export_otu_csv(otu_table(rows, sample_ids(rows, "BMlabid"), agg="sum"), out)
    return spark.read.csv(out, header=True)


@query("safe_names", """SELECT p_partkey AS "Gene_refGene", p_size AS "a_b_c" FROM part""")
def _(spark, sf):
    return safe_names(D.table(spark, sf, "part").select(F.col("p_partkey").alias("Gene.refGene"), F.col("p_size").alias("a.b.c")))


@query("search_log_replayed", _SPEC_SQL)
def _(spark, sf):
    from workloads.derive import order_tables

    path = folder(spark, "log")
    L.log_spec(L.log_row(spark, "q1", "ann", "orders", SPEC, "large returned orders"), path)
    return L.replay(spark.read.parquet(path), "q1", order_tables(spark, sf))


@query("export_mode_csv", f"""WITH {D.COHORT_SQL} SELECT variant_key::VARCHAR AS variant_key, "CHROM", "Sample_ID" AS "Sample" FROM trio WHERE {RULES['autosomal_dominant']}""")
def _(spark, sf):
    from workloads.family import tables_of

    out = folder(spark, "csv")
    spec = QuerySpec([Attribute("CHROM"), Attribute("Sample_ID", "sample", "Sample")])
    L.export_mode_csv(tables_of(spark, sf), "autosomal_dominant", spec, out)
    return spark.read.csv(out, header=True)


@query("load_case_control_ids", f"""WITH {_CASES} SELECT k, CASE WHEN c THEN k % 9 END AS "AC_case", CASE WHEN o THEN k % 4 END AS "AC_control", CASE WHEN c THEN 'rs' || k END AS "ID",
 (CASE WHEN c THEN 1 ELSE 0 END + CASE WHEN o THEN 1 ELSE 0 END) AS calls, 1 AS transcripts FROM v WHERE c OR o""")
def _(spark, sf):
    # The cases' lines carry an ID, the controls' do not: they are the same variants all the same.
    tables, _ = load_case_control(spark, write_vcf(spark, _heading("C1"), _cohort_lines(spark, sf, "k % 2 = 0 OR k % 5 = 0", ["'0/1'"], ident="concat('rs', k)")),
                                  write_vcf(spark, _heading("K1"), _cohort_lines(spark, sf, "k % 2 = 1", ["'1/1'"], "1", "k % 4")), profile=False)
    called = tables.paths["sample"].groupBy("variant_key").agg(F.count(F.lit(1)).alias("calls"))
    lof = tables.paths["LOF"].groupBy("variant_key").agg(F.count(F.lit(1)).cast("int").alias("transcripts"))
    return tables.base.join(called, "variant_key").join(lof, "variant_key").select((F.col("POS") / 10).cast("long").alias("k"), "AC_case", "AC_control", "ID", "calls", "transcripts")


@query("publish_run", f"""WITH {_CASES}, s AS (SELECT k, CASE WHEN k % 3 = 0 THEN '1' ELSE '2' END AS "CHROM", c OR o AS first, k % 3 <> 0 AND k % 2 = 1 AS second FROM v)
 SELECT k, "CHROM", CASE WHEN first THEN k % 9 END AS "AC_r1", CASE WHEN second THEN k % 4 END AS "AC_r2", concat_ws(',', CASE WHEN first THEN 'r1=' || (k % 50) END, CASE WHEN second THEN 'r2=' || (k % 50) END) AS depths,
  concat_ws(',', CASE WHEN first THEN 'C1' END, CASE WHEN second THEN 'K1' END) AS samples, CASE WHEN first THEN 1 ELSE 0 END AS transcripts FROM s WHERE first OR second""")
def _(spark, sf):
    # A run on one chromosome, without the annotation that the store has, published into the store.
    lines = _cohort_lines(spark, sf, "(k % 2 = 0 OR k % 5 = 0 OR k % 2 = 1) AND k % 3 = 0", ["'0/1'"]).union(_cohort_lines(spark, sf, "(k % 2 = 0 OR k % 5 = 0 OR k % 2 = 1) AND k % 3 <> 0", ["'0/1'"], "2"))
    first, _ = load_vcf(spark, write_vcf(spark, _heading("C1"), lines), profile=False)
    bare = _cohort_lines(spark, sf, "k % 3 <> 0 AND k % 2 = 1", ["'1/1'"], "2", "k % 4").select(F.regexp_replace("value", r";LOF=[^\t]*", "").alias("value"))
    second, _ = load_vcf(spark, write_vcf(spark, [x for x in _heading("K1") if "ID=LOF" not in x], bare), profile=False)
    store = folder(spark, "store")
    write_tables(labelled_run(first, "r1", ["DP"]), store, bucket=5_000)
    tables = publish_run(spark, store, second, "r2", ["DP"], bucket=5_000)
    called = tables.paths["sample"].groupBy("variant_key").agg(F.array_join(F.array_sort(F.collect_set("Sample_ID")), ",").alias("samples"))
    lof = tables.paths["LOF"].groupBy("variant_key").agg(F.count(F.lit(1)).cast("int").alias("transcripts"))
    depths = F.array_join(F.array_sort(F.transform("DP", lambda e: F.concat(e["DP_label"], F.lit("="), e["DP_value"].cast("string")))), ",")
    return tables.base.join(called, "variant_key").join(lof, "variant_key", "left").select(
        (F.col("POS") / 10).cast("long").alias("k"), "CHROM", "AC_r1", "AC_r2", depths.alias("depths"), "samples", F.coalesce("transcripts", F.lit(0)).alias("transcripts"))

"""Pedigree joins, inheritance modes and trio queries over the derived cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.functions.scalars import alt_count
from helixloom.operators import facets as G
from helixloom.operators import genotypes as N
from helixloom.operators import inheritance as I
from helixloom.operators.sizing import spread
from helixloom.plans.spec import Attribute, FieldFilter, QuerySpec, run_spec, run_spec_nested, search_mode
from helixloom.sources.warehouse import Tables
from workloads import derive as D
from workloads.registry import query

KEYS = ["variant_key"]
HET, REF, ALT = "('0/1','0|1','1|0')", "('0/0','0|0')", "('1/1','1|1')"
XREF = "('0','0/0','0|0')"
CARRIER = "('0/1','0|1','1|0','1','./1','.|1','1|.')"
AUTOSOME = "\"CHROM\" NOT IN ('X','Y')"
AFFECTED = "\"Phenotype\" = '2'"
HEALTHY = "\"Father_Phenotype\" = '1' AND \"Mother_Phenotype\" = '1'"
OUT_PAR = "\"CHROM\" = 'X' AND NOT (\"POS\" > 60001 AND \"POS\" < 2699520) AND NOT (\"POS\" > 154931044 AND \"POS\" < 155260560)"
OUT_PAR38 = "\"CHROM\" = 'X' AND NOT (\"POS\" > 10001 AND \"POS\" < 2781479) AND NOT (\"POS\" > 155701383 AND \"POS\" < 156030895)"


def _x_dominant(par: str) -> str:
    maternal = f"\"Mother_Genotype\" IN {HET} AND \"Mother_Phenotype\" = '2' AND \"Father_Genotype\" IN {XREF} AND \"Father_Phenotype\" = '1'"
    paternal = f"\"Mother_Genotype\" IN {REF} AND \"Mother_Phenotype\" = '1' AND \"Father_Genotype\" IN {CARRIER} AND \"Father_Phenotype\" = '2'"
    male = "\"GT\" IN ('0/1','0|1','1|0','1/1','1|1','1','./1','.|1','1|.')"
    return f"{par} AND {AFFECTED} AND ((\"Sex\" = '1' AND {male} AND {maternal}) OR (\"Sex\" = '2' AND \"GT\" IN {HET} AND (({maternal}) OR ({paternal}))))"


RULES = {
    "autosomal_recessive": f"{AUTOSOME} AND \"GT\" IN {ALT} AND {AFFECTED} AND {HEALTHY} AND \"Father_Genotype\" IN {HET} AND \"Mother_Genotype\" IN {HET} AND lof",
    "denovo": f"{AUTOSOME} AND \"GT\" IN {HET} AND {AFFECTED} AND {HEALTHY} AND \"Father_Genotype\" IN {REF} AND \"Mother_Genotype\" IN {REF}",
    "autosomal_dominant": f"""{AUTOSOME} AND "GT" IN {HET} AND {AFFECTED} AND (("Mother_Phenotype" = '2' AND "Father_Phenotype" <> '2' AND "Mother_Genotype" IN {HET}
 AND "Father_Genotype" IN {REF}) OR ("Father_Phenotype" = '2' AND "Mother_Phenotype" <> '2' AND "Father_Genotype" IN {HET} AND "Mother_Genotype" IN {REF}))""",
    "x_linked_dominant": _x_dominant(OUT_PAR),
    "x_linked_recessive": f"""{OUT_PAR} AND {AFFECTED} AND lof AND "Mother_Genotype" IN {HET} AND "Mother_Phenotype" = '1' AND (("Sex" = '1' AND "GT" NOT IN {XREF})
 OR ("Sex" = '2' AND "GT" IN {ALT} AND "Father_Genotype" IN {CARRIER} AND "Father_Phenotype" = '2'))""",
    "x_linked_denovo": f"""{OUT_PAR} AND {AFFECTED} AND {HEALTHY} AND "Father_Genotype" IN {XREF} AND "Mother_Genotype" IN {XREF}
 AND (("Sex" = '1' AND "GT" IN ('0/1','0|1','1|0','1/1','1|1','1')) OR ("Sex" = '2' AND "GT" IN {HET}))""",
}
MATERNAL = f"\"Mother_Genotype\" IN {HET} AND \"Father_Genotype\" IN {REF}"
PATERNAL = f"\"Father_Genotype\" IN {HET} AND \"Mother_Genotype\" IN {REF}"
COMPOUND_CTE = f"""cand AS (SELECT *, {MATERNAL} AS m, {PATERNAL} AS f FROM trio WHERE {AUTOSOME} AND "GT" IN {HET} AND {AFFECTED} AND {HEALTHY} AND lof
 AND (({MATERNAL}) OR ({PATERNAL}))), pairs AS (SELECT "Sample_ID", gene FROM cand GROUP BY ALL HAVING bool_or(m) AND bool_or(f)),
 compound AS (SELECT cand.* FROM cand JOIN pairs USING ("Sample_ID", gene))"""
WITH = f"WITH {D.COHORT_SQL}"


def _mode_query(mode: str, condition, sql: str) -> None:
    @query(mode, f'{WITH} SELECT variant_key, "Sample_ID", "Family_ID", "GT" FROM trio WHERE {sql}')
    def _(spark, sf):
        return D.trio_rows(spark, sf).filter(condition()).select("variant_key", "Sample_ID", "Family_ID", "GT")


for _name, _fn in (("autosomal_recessive", I.autosomal_recessive), ("denovo", I.denovo), ("autosomal_dominant", I.autosomal_dominant),
                   ("x_linked_dominant", I.x_linked_dominant), ("x_linked_recessive", I.x_linked_recessive), ("x_linked_denovo", I.x_linked_denovo)):
    _mode_query(_name, _fn, RULES[_name])
_mode_query("denovo_strict", lambda: I.denovo(strict=True),
            RULES["denovo"].replace(f'"Father_Genotype" IN {REF}', "\"Father_Genotype\" = '0/0'").replace(f'"Mother_Genotype" IN {REF}', "\"Mother_Genotype\" = '0/0'"))
_mode_query("x_linked_dominant_hg38", lambda: I.x_linked_dominant("hg38"), _x_dominant(OUT_PAR38))


@query("compound_heterozygous", f'{WITH}, {COMPOUND_CTE} SELECT variant_key, "Sample_ID", gene FROM compound')
def _(spark, sf):
    return I.compound_het(D.trio_rows(spark, sf), "genes").select("variant_key", "Sample_ID", "gene")


@query("compound_heterozygous_gene_table", f'{WITH}, {COMPOUND_CTE} SELECT variant_key, "Sample_ID", gene FROM compound')
def _(spark, sf):
    return I.compound_het(D.trio_rows(spark, sf), D.gene_table(spark, sf)).select("variant_key", "Sample_ID", "gene")


@query("candidate_genes", f"""{WITH} SELECT DISTINCT gene FROM trio WHERE {AUTOSOME} AND "GT" IN {HET} AND {AFFECTED} AND {HEALTHY} AND lof""")
def _(spark, sf):
    return I.candidate_genes(D.trio_rows(spark, sf), D.gene_table(spark, sf))


_TAGGED = " UNION ALL ".join([f"""SELECT '{m}' AS mode, variant_key, "Sample_ID" FROM trio WHERE {w}""" for m, w in RULES.items()]
                             + ["""SELECT DISTINCT 'compound_heterozygous', variant_key, "Sample_ID" FROM compound"""])
_ORDER = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(["autosomal_recessive", "denovo", "autosomal_dominant", "x_linked_dominant",
                                                               "x_linked_recessive", "x_linked_denovo", "compound_heterozygous"]))


def tagged(spark, sf) -> DataFrame:
    return I.tag_modes(D.trio_rows(spark, sf), "genes")


@query("tag_modes", f"""{WITH}, {COMPOUND_CTE}, tags AS ({_TAGGED}) SELECT variant_key, "Sample_ID",
 coalesce(string_agg(mode, ',' ORDER BY CASE mode {_ORDER} END), '') AS modes FROM trio LEFT JOIN tags USING (variant_key, "Sample_ID") GROUP BY ALL""")
def _(spark, sf):
    return tagged(spark, sf).select("variant_key", "Sample_ID", F.array_join("mendelian_diseases", ",").alias("modes"))


@query("tag_modes_gene_table", f"""{WITH}, {COMPOUND_CTE}, tags AS ({_TAGGED}) SELECT variant_key, "Sample_ID", mode FROM tags""")
def _(spark, sf):
    out = I.tag_modes(D.trio_rows(spark, sf), D.gene_table(spark, sf))
    return out.select("variant_key", "Sample_ID", F.explode("mendelian_diseases").alias("mode"))


@query("tag_modes_twice", f"""{WITH}, {COMPOUND_CTE}, tags AS ({_TAGGED}) SELECT mode, count(*) AS samples FROM tags GROUP BY 1""")
def _(spark, sf):
    return I.mode_counts(I.tag_modes(tagged(spark, sf), "genes"))


@query("mode_counts", f"""{WITH}, {COMPOUND_CTE}, tags AS ({_TAGGED}) SELECT mode, count(DISTINCT (variant_key, "Sample_ID")) AS samples FROM tags GROUP BY 1""")
def _(spark, sf):
    return I.mode_counts(tagged(spark, sf))


def tables_of(spark, sf) -> Tables:
    base = D.variants(spark, sf).select("variant_key", "CHROM", "POS", "gene", "p_size")
    return Tables(base, {"sample": tagged(spark, sf).drop("CHROM", "POS", "genes", "lof")}, unique={"sample": ["Sample_ID"]})


_MODE_SPEC = QuerySpec([Attribute("CHROM"), Attribute("gene"), Attribute("Sample_ID", "sample"), Attribute("GT", "sample")],
                       [FieldFilter("nested_filter_terms", "Family_ID", "family1\nfamily4", path="sample"),
                        FieldFilter("filter_range_gte", "p_size", "10")], limit=None)


@query("search_mode", f"""{WITH} SELECT trio.variant_key, trio."CHROM", trio.gene, "Sample_ID", "GT" FROM trio JOIN part ON p_partkey = variant_key
 WHERE {RULES['denovo']} AND "Family_ID" IN ('family1', 'family4') AND p_size >= 10""")
def _(spark, sf):
    return search_mode(tables_of(spark, sf), "denovo", _MODE_SPEC)


_MODE_ARRAY = f"""{WITH}, {COMPOUND_CTE} SELECT DISTINCT variant_key, "CHROM", gene, "Sample_ID", "GT" FROM compound JOIN part ON p_partkey = variant_key
 WHERE "Family_ID" IN ('family1', 'family4') AND p_size >= 10"""


@query("search_mode_long", _MODE_ARRAY)
def _(spark, sf):
    return search_mode(tables_of(spark, sf), "compound_heterozygous", _MODE_SPEC)


@query("search_mode_arrays", _MODE_ARRAY)
def _(spark, sf):
    t = tables_of(spark, sf)
    docs = t.base.join(N.sample_arrays(t.paths["sample"], KEYS), KEYS)
    spec = QuerySpec(_MODE_SPEC.attributes, _MODE_SPEC.filters, limit=None, mode="compound_heterozygous")
    return run_spec_nested(docs, spec)


@query("kindred", f"""{WITH}, hit AS (SELECT variant_key, "Sample_ID", "Family_ID" FROM trio WHERE {RULES['autosomal_dominant']})
 SELECT * FROM hit WHERE variant_key IN (SELECT variant_key FROM hit GROUP BY 1 HAVING count(DISTINCT "Family_ID") > 1)""")
def _(spark, sf):
    hit = D.trio_rows(spark, sf).filter(I.autosomal_dominant()).select("variant_key", "Sample_ID", "Family_ID")
    return I.kindred(hit, 1)


@query("kindred_search", f"""{WITH}, hit AS (SELECT * FROM trio WHERE {RULES['autosomal_dominant']})
 SELECT variant_key, "CHROM", "Sample_ID" FROM hit WHERE variant_key IN (SELECT variant_key FROM hit GROUP BY 1 HAVING count(DISTINCT "Family_ID") > 1)""")
def _(spark, sf):
    spec = QuerySpec([Attribute("CHROM"), Attribute("Sample_ID", "sample")], [], limit=None, mode="autosomal_dominant", kindred=1)
    return run_spec(tables_of(spark, sf), spec)


@query("family_count", f"""{WITH} SELECT count(DISTINCT "Family_ID") AS families FROM trio""")
def _(spark, sf):
    return G.family_count(D.trio_rows(spark, sf))


@query("outside_par", f"""WITH v AS ({D.VARIANTS_SQL}) SELECT variant_key, "POS" FROM v WHERE {OUT_PAR}""")
def _(spark, sf):
    return D.variants(spark, sf).filter(I.outside_par("hg19")).select("variant_key", "POS")


@query("outside_par_hg38", f"""WITH v AS ({D.VARIANTS_SQL}) SELECT variant_key, "POS" FROM v WHERE {OUT_PAR38}""")
def _(spark, sf):
    return D.variants(spark, sf).filter(I.outside_par("hg38")).select("variant_key", "POS")


# --- genotypes and pedigree ----------------------------------------------------------------


@query("unpivot_genotypes", f"""{WITH} SELECT g.variant_key, g."Sample_ID", g."GT", (g.variant_key % 50 + 10)::INT AS "AD_ref",
 (g.variant_key % 30 + substr("Sample_ID", 2, 1)::INT)::INT AS "AD_alt", (g.variant_key % 80 + 10)::INT AS "DP", (g.variant_key % 99)::INT AS "GQ" FROM gts g""")
def _(spark, sf):
    raw = spread(D.variants(spark, sf)).select("variant_key", F.lit("GT:AD:DP:GQ").alias("format"), D.calls(F.col("variant_key")).alias("calls"))
    return N.unpivot_genotypes(raw, D.SAMPLES, KEYS, {"GT": "string", "AD": "integer", "DP": "integer", "GQ": "integer"})


def _raw_with_gaps(spark, sf) -> DataFrame:
    """The cohort with missing calls: every seventh variant of family 2, in several spellings."""
    k = F.col("variant_key")
    shapes = F.element_at(F.lit(["./.:.:.", ".|.", "0/.:3,4:9", ".|0:1,1:2", "./0:5,6:7"]), (k % 5 + 1).cast("int"))
    at = F.col("variant_key") % 7 == 0
    cells = F.transform(D.calls(k), lambda c, i: F.when(at & (i >= 3) & (i < 6), shapes).otherwise(c))
    return spread(D.variants(spark, sf)).select("variant_key", F.lit("GT:AD:DP:GQ").alias("format"), cells.alias("calls"))


_GAPS = f"""gap AS (SELECT variant_key, "Sample_ID", CASE WHEN variant_key % 7 = 0 AND "Sample_ID" LIKE 'F2%'
 THEN (['./.','.|.','0/.','.|0','./0'])[(variant_key % 5 + 1)::INT] ELSE "GT" END AS "GT" FROM gts)"""


@query("unpivot_without_homref", f"""{WITH}, {_GAPS} SELECT variant_key, "Sample_ID", "GT" FROM gap
 WHERE "GT" NOT IN ('./.','.|.','0/.','.|0','0/0','0|0')""")
def _(spark, sf):
    return N.unpivot_genotypes(_raw_with_gaps(spark, sf), D.SAMPLES, KEYS, keep_homref=False).select("variant_key", "Sample_ID", "GT")


@query("unpivot_nocall_as_homref", f"""{WITH}, {_GAPS} SELECT variant_key, "Sample_ID", CASE WHEN "GT" = './.' THEN '0/0' ELSE "GT" END AS "GT",
 CASE WHEN "GT" = './.' THEN 0 WHEN "GT" = '.|.' THEN NULL WHEN "GT" = '0/.' THEN 3 WHEN "GT" = '.|0' THEN 1 WHEN "GT" = './0' THEN 5
 ELSE variant_key % 50 + 10 END::INT AS "AD_ref" FROM gap""")
def _(spark, sf):
    return N.unpivot_genotypes(_raw_with_gaps(spark, sf), D.SAMPLES, KEYS, nocall="homref").select("variant_key", "Sample_ID", "GT", "AD_ref")


_PED = """ped AS (SELECT 'F' || fam || r AS "Sample_ID", 'family' || fam AS "Family_ID", CASE r WHEN 'C' THEN 'F' || fam || 'F' END AS "Father_ID",
 CASE r WHEN 'C' THEN 'F' || fam || 'M' END AS "Mother_ID", CASE r WHEN 'C' THEN "Sex" WHEN 'F' THEN '1' ELSE '2' END AS "Sex",
 CASE r WHEN 'C' THEN "Phenotype" WHEN 'F' THEN "Father_Phenotype" ELSE "Mother_Phenotype" END AS "Phenotype" FROM fams, (VALUES ('C'),('F'),('M')) AS q(r))"""
_JOINED = f"""{WITH}, {_GAPS}, {_PED} SELECT g.variant_key, g."Sample_ID", g."GT", p."Family_ID", p."Father_ID", p."Mother_ID", p."Sex", p."Phenotype",
 fp."Phenotype" AS "Father_Phenotype", mp."Phenotype" AS "Mother_Phenotype", fg."GT" AS "Father_Genotype", mg."GT" AS "Mother_Genotype"
 FROM gap g LEFT JOIN ped p ON p."Sample_ID" = g."Sample_ID" LEFT JOIN ped fp ON fp."Sample_ID" = p."Father_ID" LEFT JOIN ped mp ON mp."Sample_ID" = p."Mother_ID"
 LEFT JOIN gap fg ON fg.variant_key = g.variant_key AND fg."Sample_ID" = p."Father_ID" LEFT JOIN gap mg ON mg.variant_key = g.variant_key AND mg."Sample_ID" = p."Mother_ID"
 WHERE g."GT" NOT IN ('./.','.|.','0/.','.|0')"""
_FAMILY_COLUMNS = ["variant_key", "Sample_ID", "GT", "Family_ID", "Father_ID", "Mother_ID", "Sex", "Phenotype", "Father_Phenotype", "Mother_Phenotype",
                   "Father_Genotype", "Mother_Genotype"]


@query("join_pedigree", _JOINED)
def _(spark, sf):
    g = N.unpivot_genotypes(_raw_with_gaps(spark, sf), D.SAMPLES, KEYS, nocall="keep")
    return N.drop_uncalled(N.join_pedigree(g, D.pedigree(spark), KEYS)).select(*_FAMILY_COLUMNS)


@query("join_pedigree_in_line", _JOINED)
def _(spark, sf):
    g = N.unpivot_with_pedigree(_raw_with_gaps(spark, sf), D.SAMPLES, KEYS, D.pedigree(spark))
    return g.select(*_FAMILY_COLUMNS)


_SIBLINGS = f"""{WITH} SELECT g.variant_key, g."Sample_ID", g."GT", CASE WHEN g."Sample_ID" = 'F4C' THEN a."GT" || ',' || b."GT" END AS "Affected_Siblings_Genotypes",
 CASE WHEN g."Sample_ID" = 'F4C' THEN c."GT" || ',' || d."GT" END AS "Unaffected_Siblings_Genotypes" FROM gts g
 JOIN gts a ON a.variant_key = g.variant_key AND a."Sample_ID" = 'F2C' JOIN gts b ON b.variant_key = g.variant_key AND b."Sample_ID" = 'F1C'
 JOIN gts c ON c.variant_key = g.variant_key AND c."Sample_ID" = 'F1F' JOIN gts d ON d.variant_key = g.variant_key AND d."Sample_ID" = 'F1M'"""


@query("join_siblings", _SIBLINGS)
def _(spark, sf):
    out = N.join_siblings(D.genotypes(spark, sf), D.pedigree(spark), KEYS)
    return out.select("variant_key", "Sample_ID", "GT", "Affected_Siblings_Genotypes", "Unaffected_Siblings_Genotypes")


@query("join_siblings_in_line", _SIBLINGS)
def _(spark, sf):
    raw = spread(D.variants(spark, sf)).select("variant_key", F.lit("GT:AD:DP:GQ").alias("format"), D.calls(F.col("variant_key")).alias("calls"))
    out = N.unpivot_with_pedigree(raw, D.SAMPLES, KEYS, D.pedigree(spark), siblings=True)
    return out.select("variant_key", "Sample_ID", "GT", "Affected_Siblings_Genotypes", "Unaffected_Siblings_Genotypes")


@query("trio_carriers", f"""{WITH} SELECT 'family' || substr("Sample_ID", 2, 1) AS "Family_ID", "Sample_ID" AS child, count(*) AS carried FROM gts
 WHERE "Sample_ID" LIKE '%C' AND "GT" NOT IN ('0/0', '0|0') GROUP BY ALL""")
def _(spark, sf):
    found = N.trios(D.pedigree(spark))
    carried = D.genotypes(spark, sf).filter(~F.col("GT").isin("0/0", "0|0"))
    return (carried.join(found, F.col("Sample_ID") == F.col("child")).groupBy("Family_ID", "child")
            .agg(F.count(F.lit(1)).alias("carried")))


@query("alt_count", f"""{WITH} SELECT variant_key, sum(length(replace(replace(replace("GT", '0', ''), '/', ''), '|', '')))::BIGINT AS alt FROM gts GROUP BY 1""")
def _(spark, sf):
    return D.genotypes(spark, sf).groupBy("variant_key").agg(F.sum(alt_count("GT")).alias("alt"))


@query("family_elements", f"""{WITH} SELECT variant_key, string_agg("Sample_ID" || '=' || "GT", ',' ORDER BY "Sample_ID") AS members FROM gts
 WHERE "Sample_ID" LIKE 'F3%' GROUP BY 1""")
def _(spark, sf):
    g = D.genotypes(spark, sf).withColumn("Family_ID", F.concat(F.lit("family"), F.substring("Sample_ID", 2, 1)))
    docs = N.family_elements(N.sample_arrays(g, KEYS), "sample", "family3")
    text = F.array_join(F.array_sort(F.transform("sample", lambda e: F.concat(e["Sample_ID"], F.lit("="), e["GT"]))), ",")
    return docs.select("variant_key", text.alias("members"))


# --- ad-hoc trios: a cohort whose reference calls were not stored ---------------------------

_SPARSE = f"""{WITH}, s AS (SELECT * FROM gts WHERE "GT" NOT IN {REF}), t AS (SELECT variant_key, max(CASE WHEN "Sample_ID" = 'F1F' THEN "GT" END) AS father_gt,
 max(CASE WHEN "Sample_ID" = 'F1M' THEN "GT" END) AS mother_gt, max(CASE WHEN "Sample_ID" = 'F1C' THEN "GT" END) AS child_gt FROM s
 WHERE "Sample_ID" IN ('F1C','F1F','F1M') GROUP BY 1)"""
_TRIO_RULES = {
    "recessive": f"child_gt IN {ALT} AND father_gt IN {HET} AND mother_gt IN {HET}",
    "dominant": f"child_gt IN {HET} AND ((mother_gt IN {HET} AND father_gt IS NULL) OR (father_gt IN {HET} AND mother_gt IS NULL))",
    "denovo": f"child_gt IN {HET} AND father_gt IS NULL AND mother_gt IS NULL",
}


def _trio(mode: str) -> None:
    @query(f"trio_{mode}", f"{_SPARSE} SELECT * FROM t WHERE {_TRIO_RULES[mode]}")
    def _(spark, sf):
        sparse = D.genotypes(spark, sf).filter(~F.col("GT").isin("0/0", "0|0"))
        return I.trio_query(sparse, "F1C", "F1F", "F1M", mode, KEYS)


for _mode in _TRIO_RULES:
    _trio(_mode)

_TRIO_HET = "('0/1','0|1','1/0','1|0')"


@query("trio_compound_het", f"""{WITH}, t AS (SELECT variant_key, gene, "Father_Genotype" AS father_gt, "Mother_Genotype" AS mother_gt, "GT" AS child_gt,
 "Mother_Genotype" IN {_TRIO_HET} AND "Father_Genotype" IN {REF} AS m, "Father_Genotype" IN {_TRIO_HET} AND "Mother_Genotype" IN {REF} AS f
 FROM trio WHERE "Sample_ID" = 'F1C' AND lof AND "GT" IN {_TRIO_HET}), c AS (SELECT * FROM t WHERE m OR f)
 SELECT gene, variant_key, father_gt, mother_gt, child_gt FROM c WHERE gene IN (SELECT gene FROM c GROUP BY 1 HAVING bool_or(m) AND bool_or(f))""")
def _(spark, sf):
    return I.trio_compound_het(D.genotypes(spark, sf), D.gene_table(spark, sf), "F1C", "F1F", "F1M", KEYS)


@query("pedigree_text", """SELECT 'fam' || c_custkey AS family, c_name AS sample, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE 'D' || c_nationkey END AS father,
 CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE 'M' || c_nationkey END AS mother, (c_custkey % 2 + 1)::VARCHAR AS sex FROM customer""")
def _(spark, sf):
    from helixloom.sources.pedigree import split_pedigree

    c, n = F.col("c_custkey"), F.col("c_nationkey")
    rest = F.when(c % 2 == 0, F.lit("\t-9\t-9\t-9\t-9\t-9\t-9\tNA")).otherwise(F.lit(""))
    line = F.concat(F.lit("fam"), c, F.lit("\t"), F.col("c_name"), F.lit("\t"), F.when(n % 3 == 0, "-9").otherwise(F.concat(F.lit("D"), n)),
                    F.lit(" "), F.when(n % 4 == 0, "NA").otherwise(F.concat(F.lit("M"), n)), F.lit("\t"), (c % 2 + 1).cast("string"), F.lit("\t2"), rest)
    lines = D.table(spark, sf, "customer").select(line.alias("value"))
    return split_pedigree(lines).select("family", "sample", "father", "mother", "sex")


@query("outside_intervals", f"""WITH v AS ({D.VARIANTS_SQL}), i AS (SELECT (['1','2','X','7'])[n_nationkey % 4 + 1] AS ichr, n_nationkey * 1500000 AS s, n_nationkey * 1500000 + 2600000 AS e FROM nation)
 SELECT variant_key, "CHROM", "POS" FROM v WHERE NOT EXISTS (SELECT 1 FROM i WHERE ichr = "CHROM" AND "POS" > s AND "POS" < e)""")
def _(spark, sf):
    from helixloom.operators.shaping import outside_intervals

    n = F.col("n_nationkey")
    intervals = D.table(spark, sf, "nation").select(F.element_at(F.lit(["1", "2", "X", "7"]), (n % 4 + 1).cast("int")).alias("chrom"),
                                                    (n * 1500000).alias("start"), (n * 1500000 + 2600000).alias("end"))
    return outside_intervals(D.variants(spark, sf).select("variant_key", "CHROM", "POS"), intervals)

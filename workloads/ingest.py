"""VCF text read back: core fields, INFO, annotations, profiling, rejects."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixloom.functions.parsers import map_values, map_values_table, register_parser
from helixloom.functions.scalars import (
    clean_number, decode_escapes, infer_type, normalize_chrom, parse_float, region_string, start_end, variant_key,
)
from helixloom.operators import annotations as A
from helixloom.operators.info import FieldMapping, apply_mapping, info_value, parse_info, profile_fields
from helixloom.sources.vcf import header_catalog, ingest_report, normalize_variants, region, split_lines, split_rejects
from workloads import derive as D
from workloads import vcf_text as T
from workloads.registry import query

PCT = "lpad((k % 100)::VARCHAR, 2, '0')"
V = f"""WITH v AS (SELECT p_partkey AS k, p_brand AS brand, p_type AS kind FROM part), raw AS ({D.VARIANTS_SQL})"""


def _int(expr: str) -> str:
    return f"({expr})::INT"


@query("vcf_core_fields", f"""{V} SELECT variant_key AS k, 'chr' || "CHROM" || '_' || "POS" || '_' || "REF" || '_' || "ALT" AS "Variant", 'chr' || "CHROM" AS "CHROM", "POS",
 CASE variant_key % 3 WHEN 0 THEN 'rs' || variant_key WHEN 2 THEN 'id' || variant_key END AS "ID",
 CASE WHEN variant_key % 10 = 0 THEN 100.0 ELSE variant_key % 90 + 0.5 END::DOUBLE AS "QUAL",
 CASE variant_key % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'q10,s50' ELSE 'q10' END AS filters,
 CASE variant_key % 3 WHEN 0 THEN 'rs' || variant_key END AS dbsnp, 'SNV' AS "VariantType" FROM raw""")
def _(spark, sf):
    v = normalize_variants(T.parsed(spark, sf))
    return v.select("k", "Variant", "CHROM", "POS", "ID", "QUAL", F.array_join("FILTER", ",").alias("filters"),
                    F.array_join("dbSNP_ID", ",").alias("dbsnp"), "VariantType")


@query("normalize_chrom", f"""{V} SELECT variant_key AS k, "CHROM" FROM raw""")
def _(spark, sf):
    return T.parsed(spark, sf).select("k", normalize_chrom("CHROM").alias("CHROM"))


@query("region_scan", f"""{V} SELECT variant_key, "POS" FROM raw WHERE "CHROM" = 'X' AND "POS" BETWEEN 1000000 AND 9000000""")
def _(spark, sf):
    return region(D.variants(spark, sf), "X", 1_000_000, 9_000_000).select("variant_key", "POS")


@query("region_string", f"""{V} SELECT variant_key, 'chr' || "CHROM" || ':' || ("POS" - 25) || '-' || ("POS" + 25) AS browser,
 "CHROM" || ':' || ("POS" - 25) || '-' || ("POS" + 25) || '/location/' || "CHROM" || ':' || "POS" || '-' || "POS" AS decipher FROM raw""")
def _(spark, sf):
    ident = F.concat_ws("_", "CHROM", F.col("POS").cast("string"), "REF", "ALT")
    return D.variants(spark, sf).select("variant_key", region_string(ident).alias("browser"), region_string(ident, kind="decipher").alias("decipher"))


@query("variant_class", f"""{V} SELECT variant_key, CASE WHEN length(a) = 1 THEN 'SNV' ELSE 'INDEL' END AS by_base,
 CASE WHEN length(a) = 1 THEN 'SNV' ELSE 'INDEL' END AS by_length FROM (SELECT variant_key, repeat("ALT", (variant_key % 3 + 1)::INT) AS a FROM raw)""")
def _(spark, sf):
    from helixloom.functions.scalars import variant_class

    alt = F.repeat("ALT", (F.col("variant_key") % 3 + 1).cast("int"))
    return D.variants(spark, sf).select("variant_key", variant_class("REF", alt).alias("by_base"), variant_class("REF", alt, "length").alias("by_length"))


@query("variant_key", f"""{V} SELECT count(DISTINCT variant_key) AS keys, 56 AS key_length FROM raw""")
def _(spark, sf):
    keyed = D.variants(spark, sf).select(variant_key("CHROM", "POS", "REF", "ALT", F.lit("."), F.lit("cohort")).alias("key"))
    return keyed.agg(F.countDistinct("key").alias("keys"), F.max(F.length("key")).alias("key_length"))


@query("vcf_info_fields", f"""{V} SELECT k, k % 7 AS "AC", CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN 999.99 ELSE (k % 100) / 100.0 END::DOUBLE AS "AF",
 k % 40 AS "AN", CASE WHEN k % 9 <> 0 THEN k % 500 END AS "DP", (k % 3)::VARCHAR AS "FS", CASE WHEN k % 2 = 0 THEN 'Yes' ELSE 'No' END AS "NOVEL",
 'a=' || (k % 5) || ';b' AS "Note", CASE WHEN k % 5 = 0 THEN 'rs' || k ELSE 'rs' || (k + 1) END AS dbsnp, kind AS class_code,
 CASE WHEN k % 4 = 0 THEN 100.0 END::DOUBLE AS vqs_score FROM v""")
def _(spark, sf):
    out = parse_info(T.parsed(spark, sf), T.INFO_TYPES)
    return out.select("k", "AC", "AF", "AN", "DP", "FS", "NOVEL", "Note", F.array_join("dbSNP_ID", ",").alias("dbsnp"), "class_code", "vqs_score")


@query("vcf_info_case_suffix", f"""{V} SELECT k, k % 7 AS "AC_case", k % 40 AS "AN_case", 'a=' || (k % 5) || ';b' AS "Note" FROM v""")
def _(spark, sf):
    out = parse_info(T.parsed(spark, sf), {"AC": "integer", "AN": "integer", "Note": "string"}, group="_case")
    return out.select("k", "AC_case", "AN_case", "Note")


@query("profile_fields", f"""{V} SELECT section, name, type, filled::BIGINT AS filled, seen::BIGINT AS seen FROM (
 SELECT 'INFO' AS section, 'AC' AS name, 'integer' AS type, count(*) AS filled, count(*) AS seen FROM v
 UNION ALL SELECT 'INFO', 'AF', 'float', count(*), count(*) FROM v
 UNION ALL SELECT 'INFO', 'DP', 'integer', count_if(k % 9 <> 0), count(*) FROM v
 UNION ALL SELECT 'INFO', 'AN', 'integer', 2 * count(*), 2 * count(*) FROM v
 UNION ALL SELECT 'INFO', 'vqs_score', 'keyword', count(*), count(*) FROM v
 UNION ALL SELECT 'INFO', 'NOVEL', NULL, 0, count_if(k % 2 = 0) FROM v
 UNION ALL SELECT 'CSQ', 'gnomAD_AF', 'float', count(*), 2 * count(*) FROM v
 UNION ALL SELECT 'CSQ', 'DISTANCE', 'integer', count(*), 2 * count(*) FROM v
 UNION ALL SELECT 'FORMAT', 'GT', 'keyword', 15 * count(*), 15 * count(*) FROM v
 UNION ALL SELECT 'FORMAT', 'DP', 'integer', 15 * count(*), 15 * count(*) FROM v)""")
def _(spark, sf):
    found = profile_fields(T.parsed(spark, sf), T.CSQ_FIELDS)
    shown = {"INFO": ["AC", "AF", "DP", "AN", "vqs_score", "NOVEL"], "CSQ": ["gnomAD_AF", "DISTANCE"], "FORMAT": ["GT", "DP"]}
    test = F.lit(False)
    for section, names in shown.items():
        test = test | ((F.col("section") == section) & F.col("name").isin(names))
    return found.filter(test)


@query("infer_type", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'integer' WHEN 1 THEN 'float' WHEN 2 THEN 'float' WHEN 3 THEN 'keyword' WHEN 4 THEN 'integer' ELSE 'float' END AS type FROM part""")
def _(spark, sf):
    k = F.col("p_partkey")
    shown = (F.when(k % 6 == 0, k.cast("string")).when(k % 6 == 1, T.text(k, ".0")).when(k % 6 == 2, "1e5").when(k % 6 == 3, T.text(k, "f"))
             .when(k % 6 == 4, T.text(" ", k, " ")).otherwise("nan"))
    return D.table(spark, sf, "part").select("p_partkey", infer_type(shown).alias("type"))


@query("clean_number", """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN -999.99 WHEN p_size % 7 = 0 THEN 999.99 ELSE p_retailprice END::DOUBLE AS value FROM part""")
def _(spark, sf):
    shown = F.when(F.col("p_size") % 5 == 0, "NaN").when(F.col("p_size") % 7 == 0, "-inf").otherwise(F.col("p_retailprice").cast("string"))
    return D.table(spark, sf, "part").select("p_partkey", clean_number(parse_float(shown), nan=-999.99).alias("value"))


@query("start_end", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_size END::BIGINT AS s, CASE p_partkey % 3 WHEN 0 THEN p_size ELSE p_size + 4 END::BIGINT AS e FROM part""")
def _(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size")
    shown = F.when(k % 3 == 0, n.cast("string")).when(k % 3 == 1, T.text(n, "-", n + 4)).otherwise(T.text("?-", n + 4))
    return D.table(spark, sf, "part").select("p_partkey", start_end(shown)["start"].alias("s"), start_end(shown)["end"].alias("e"))


@query("decode_escapes", """SELECT p_partkey, 'a=' || p_size || ';b_' || p_brand AS shown FROM part""")
def _(spark, sf):
    shown = T.text("a\\x3d", F.col("p_size"), "\\x3bb\\x2c_", F.col("p_brand"))
    return D.table(spark, sf, "part").select("p_partkey", decode_escapes(shown).alias("shown"))


@query("header_catalog", """SELECT 'INFO' AS section, p_type || '_score' AS name, 'float' AS type, count(*) || ' parts' AS description, NULL::VARCHAR AS subfields, NULL::BIGINT AS length
 FROM part GROUP BY p_type UNION ALL SELECT DISTINCT 'INFO', replace(p_brand, '#', '_'), 'integer', 'a|b', NULL, NULL FROM part
 UNION ALL SELECT 'contig', "CHROM", '', '', NULL, max("POS") FROM (%s) GROUP BY 2
 UNION ALL SELECT 'FORMAT', 'PL' || r_regionkey, 'integer', 'Likelihoods of ' || r_name, NULL, NULL FROM region""" % D.VARIANTS_SQL)
def _(spark, sf):
    return header_catalog(T.header(spark, sf)).select("section", "name", "type", "description", F.array_join("subfields", "|").alias("subfields"), "length")


# --- annotations ---------------------------------------------------------------------------


def _variant_level(spark, sf):
    nested, variant = A.build_consequences("parts", T.CSQ_FIELDS, T.CSQ_TYPES)
    return T.parsed(spark, sf).withColumn("parts", A.split_transcripts(info_value("CSQ"))), nested, variant


@query("consequences", f"""{V} SELECT k, 1 AS i, 'missense_variant,splice_region_variant' AS consequence, 'MODERATE' AS impact, brand AS symbol, {_int('k % 90')} AS cdna,
 'tolerated' AS sift_pred, (k % 100) / 100.0::DOUBLE AS sift_score, 'benign' AS polyphen_pred, 0.3::DOUBLE AS polyphen_score, NULL::INT AS distance FROM v
 UNION ALL SELECT k, 2, CASE WHEN k % 3 = 0 THEN 'stop_gained' ELSE 'intron_variant' END, 'HIGH', brand || 'b', {_int('k % 90 + 1')}, NULL, NULL, NULL, 0.9, {_int('k % 400')} FROM v""")
def _(spark, sf):
    df, nested, _ = _variant_level(spark, sf)
    e = df.select("k", F.posexplode(nested).alias("i", "c"))
    return e.select("k", (F.col("i") + 1).alias("i"), F.array_join("c.Consequence", ",").alias("consequence"), F.col("c.IMPACT").alias("impact"),
                    F.col("c.SYMBOL").alias("symbol"), F.col("c.cDNA_position").alias("cdna"), F.col("c.SIFT_pred").alias("sift_pred"),
                    F.col("c.SIFT_score").alias("sift_score"), F.col("c.PolyPhen_pred").alias("polyphen_pred"),
                    F.col("c.PolyPhen_score").alias("polyphen_score"), F.col("c.DISTANCE").alias("distance"))


@query("consequence_variant_fields", f"""{V} SELECT k, 'rs' || k AS dbsnp, 'COSM' || (k % 77) AS cosmic, ((k % 100) / 100.0)::DOUBLE AS gnomad, 'benign,risk_factor' AS clin_sig, kind AS variant_class FROM v""")
def _(spark, sf):
    df, _, variant = _variant_level(spark, sf)
    return df.select("k", F.array_join(variant["dbSNP_ID"], ",").alias("dbsnp"), F.array_join(variant["COSMIC_ID"], ",").alias("cosmic"),
                     F.get(variant["gnomAD_AF"], F.lit(0)).alias("gnomad"), F.array_join(variant["CLIN_SIG"], ",").alias("clin_sig"),
                     variant["VARIANT_CLASS"].alias("variant_class"))


@query("consequence_spans_agreed", f"""{V} SELECT k, {_int('k % 90')}::BIGINT AS s, {_int('k % 90 + 3')}::BIGINT AS e, kind AS variant_class FROM v""")
def _(spark, sf):
    nested, variant = A.build_consequences("parts", T.CSQ_FIELDS, T.CSQ_TYPES, ranges="span", global_rule="agreed")
    first = T.parsed(spark, sf).withColumn("parts", A.split_transcripts(info_value("CSQ"))).select("k", F.get(nested, F.lit(0)).alias("c"), variant["VARIANT_CLASS"].alias("variant_class"))
    return first.select("k", F.col("c.cDNA_position_start").alias("s"), F.col("c.cDNA_position_end").alias("e"), "variant_class")


_DETAIL_GENE = """CASE k % 6 WHEN 0 THEN brand || ',NEXT' || (k % 10) WHEN 1 THEN brand END"""


@query("gene_context", f"""{V} SELECT k, CASE WHEN k % 6 IN (2, 4) THEN brand END AS up, CASE k % 6 WHEN 3 THEN brand WHEN 2 THEN 'NEXT' || (k % 10) END AS down,
 CASE k % 6 WHEN 2 THEN k WHEN 4 THEN k % 800 END::INT AS up_dist, CASE WHEN k % 6 = 3 THEN k % 700 WHEN k % 6 = 2 AND k % 4 <> 0 THEN k + 5 END::INT AS down_dist,
 {_DETAIL_GENE} AS gene, CASE WHEN k % 6 = 1 THEN 'NM_' || k || ':c.-5A>G,NM_9:c.-7A>G' END AS detail FROM v""")
def _(spark, sf):
    c = A.build_gene_context(info_value("Func_refGene"), info_value("Gene_refGene"), info_value("GeneDetail_refGene"), "refGene")
    return T.parsed(spark, sf).select("k", c["Upstream_refGene"].alias("up"), c["Downstream_refGene"].alias("down"),
                                      c["Distance_to_upstream_refGene"].alias("up_dist"), c["Distance_to_downstream_refGene"].alias("down_dist"),
                                      F.array_join(c["Gene_refGene"], ",").alias("gene"), F.array_join(c["GeneDetail_refGene"], ",").alias("detail"))


@query("gene_context_always", f"""{V} SELECT k, CASE k % 6 WHEN 5 THEN brand || ',NEXT' || (k % 10) ELSE {_DETAIL_GENE} END AS gene FROM v""")
def _(spark, sf):
    c = A.build_gene_context(info_value("Func_refGene"), info_value("Gene_refGene"), info_value("GeneDetail_refGene"), "refGene", gene_always=True)
    return T.parsed(spark, sf).select("k", F.array_join(c["Gene_refGene"], ",").alias("gene"))


_AA1 = "brand || ':NM_' || k || ':exon' || (k % 9) || ':c.A' || (k % 99) || 'G:p.K' || (k % 33) || 'R'"


@query("transcript_changes", f"""{V} SELECT k, {_AA1} AS change FROM v WHERE k % 8 <> 0 UNION ALL SELECT k, 'OTHER:NM_y:exon3:c.T5A:p.L2M' FROM v WHERE k % 8 <> 0""")
def _(spark, sf):
    e = T.parsed(spark, sf).select("k", F.explode(A.build_aachange(info_value("AAChange_refGene"), "refGene")).alias("c"))
    return e.select("k", F.concat_ws(":", "c.Gene", "c.RefSeq", "c.exon_id_rg", "c.cdna_change_rg", "c.aa_change_rg").alias("change"))


@query("transcript_changes_short", f"""{V} SELECT k, count(*) AS n, count_if(p = 3)::BIGINT AS short FROM (SELECT k, unnest([5, 3, 5]) AS p FROM v WHERE k % 8 <> 0) GROUP BY k""")
def _(spark, sf):
    e = T.parsed(spark, sf).select("k", F.explode(A.build_aachange(info_value("AAChange_refGene"), "refGene", min_parts=3)).alias("c"))
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c.cdna_change_rg").isNull()).alias("short"))


@query("gene_records", f"""{V} SELECT k, brand || ' NEXT' || (k % 10) AS symbol, CASE WHEN k % 6 IN (0, 1) THEN 'NM_' || k END AS transcript, CASE k % 6 WHEN 0 THEN 'exon1' END AS location,
 CASE WHEN k % 6 = 2 THEN 'dist=' || k || ';dist=' || CASE WHEN k % 4 = 0 THEN 'NONE' ELSE (k + 5)::VARCHAR END END AS distance FROM v WHERE k % 6 IN (0, 1, 2, 5)
 UNION ALL SELECT k, brand || ' NEXT' || (k % 10), 'NM_9', NULL, NULL FROM v WHERE k % 6 = 1""")
def _(spark, sf):
    recs = A.build_gene_records(decode_escapes(info_value("Gene_refGene")), decode_escapes(info_value("GeneDetail_refGene")), "refGene")
    e = T.parsed(spark, sf).select("k", F.explode(recs).alias("r"))
    return e.select("k", F.col("r.refGene_symbol").alias("symbol"), F.col("r.refGene_refgene_id").alias("transcript"),
                    F.col("r.refGene_location").alias("location"), F.col("r.refGene_distance_to_gene").alias("distance"))


@query("prune_nested", f"""{V} SELECT k, gene, detail FROM (SELECT k, brand AS gene, NULL::VARCHAR AS detail, k % 2 = 0 AS kept FROM v
 UNION ALL SELECT k, CASE WHEN k % 2 = 0 THEN 'OTHER' ELSE brand END, 'NM_' || k, true FROM v UNION ALL SELECT k, 'NEXT' || (k % 10), NULL, true FROM v) WHERE kept""")
def _(spark, sf):
    k, none = F.col("variant_key"), F.lit(None).cast("string")

    def entry(gene, detail):
        return F.struct(gene.alias("gene"), detail.alias("detail"))

    genes = F.array(entry(F.col("gene"), none), entry(F.when(k % 2 == 0, "OTHER").otherwise(F.col("gene")), T.text("NM_", k)), entry(T.text("NEXT", k % 10), none))
    docs = D.variants(spark, sf).select(k.alias("k"), genes.alias("genes"))
    return docs.select("k", F.explode(A.prune_nested("genes", "gene", ["detail"])).alias("e")).select("k", "e.*")


@query("clinvar", f"""{V} SELECT k, 'Pathogenic' AS sig, 'dis' || (k % 6) AS disease, 'single' AS review FROM v
 UNION ALL SELECT k, CASE WHEN k % 2 = 0 THEN 'Benign' ELSE 'Uncertain' END, 'dis' || (k % 7), CASE WHEN k % 3 = 0 THEN 'multi' ELSE 'none' END FROM v""")
def _(spark, sf):
    z = A.zip_clinvar(info_value("CLNSIG"), info_value("CLNDN"), info_value("CLNREVSTAT"))
    return T.parsed(spark, sf).select("k", F.explode(z).alias("e")).select("k", F.col("e.CLNSIG").alias("sig"), F.col("e.CLNDN").alias("disease"), F.col("e.CLNREVSTAT").alias("review"))


@query("cosmic", f"""{V} SELECT k, 'COSM' || k || ',COSM' || (k + 1) AS ids, {_int('k % 9')} AS n, 'lung' AS site FROM v UNION ALL SELECT k, 'COSM' || k || ',COSM' || (k + 1), {_int('k % 4')}, 'skin' FROM v""")
def _(spark, sf):
    ids, sites = A.parse_cosmic(info_value("cosmic70"))
    e = T.parsed(spark, sf).select("k", F.array_join(ids, ",").alias("ids"), F.explode(sites).alias("e"))
    return e.select("k", "ids", F.col("e.COSMIC_Occurrence").alias("n"), F.col("e.COSMIC_Cancer_Site").alias("site"))


@query("icgc", f"""{V} SELECT k, 'LIVER-' || (k % 3) AS site, {_int('k % 12')} AS ac, {_int('k % 12 + 100')} AS an, ((k % 100) / 100.0)::DOUBLE AS af FROM v UNION ALL SELECT k, 'SKIN', 1, 200, 0.005 FROM v""")
def _(spark, sf):
    e = T.parsed(spark, sf).select("k", F.explode(A.parse_icgc(info_value("ICGC_Occurrence"))).alias("e"))
    return e.select("k", F.col("e.ICGC_Cancer_Site").alias("site"), F.col("e.ICGC_Allele_Count").alias("ac"), F.col("e.ICGC_Allele_Number").alias("an"), F.col("e.ICGC_Allele_Frequency").alias("af"))


@query("gtex", f"""{V} SELECT k, 'ENSG' || k AS gene, 'Whole_Blood' AS tissue FROM v UNION ALL SELECT k, 'ENSG' || (k + 2), 'Brain_' || (k % 8) FROM v""")
def _(spark, sf):
    e = T.parsed(spark, sf).select("k", F.explode(A.zip_gtex(info_value("GTEx_V6_gene"), info_value("GTEx_V6_tissue"))).alias("e"))
    return e.select("k", F.col("e.GTEx_V6_gene").alias("gene"), F.col("e.GTEx_V6_tissue").alias("tissue"))


@query("tracks", f"""{V} SELECT k, 'Height,Weight_' || (k % 10) AS gwas, {_int('k % 1000')} AS score, 'V$E' || (k % 15) AS site, 'mir-' || (k % 21) AS rna FROM v""")
def _(spark, sf):
    t = A.parse_score_name(info_value("tfbsConsSites"), "tfbs")
    return T.parsed(spark, sf).select("k", F.array_join(A.parse_gwas(info_value("gwasCatalog")), ",").alias("gwas"), t["tfbs_Score"].alias("score"),
                                      t["tfbs_Name"].alias("site"), A.parse_name(info_value("wgRna")).alias("rna"))


@query("snpeff_effects", f"""{V} SELECT k, brand AS gene, {_int('k % 60 + 1')} AS pos, {_int('k % 60 + 100')} AS length, {_int('k % 10')} AS distance, 'W1,W2' AS warnings FROM v
 UNION ALL SELECT k, brand || 'c', NULL, NULL, NULL, NULL FROM v""")
def _(spark, sf):
    e = T.parsed(spark, sf).select("k", F.explode(A.build_snpeff(info_value("ANN"), "ANN", T.ANN_FIELDS)).alias("e"))
    return e.select("k", F.col("e.ANN_nested_Gene_Name").alias("gene"), F.col("e.ANN_nested_cDNA_pos").alias("pos"), F.col("e.ANN_nested_cDNA_length").alias("length"),
                    F.col("e.ANN_nested_Distance").alias("distance"), F.array_join(F.col("e")["ANN_nested_ERRORS/WARNINGS/INFO"], ",").alias("warnings"))


@query("snpeff_loss", f"""{V} SELECT k, brand AS gene, {_int('k % 5 + 1')} AS transcripts, ((k % 100) / 100.0)::DOUBLE AS affected FROM v""")
def _(spark, sf):
    e = T.parsed(spark, sf).select("k", F.explode(A.build_snpeff(info_value("LOF"), "LOF", T.LOF_FIELDS)).alias("e"))
    return e.select("k", F.col("e.LOF_Gene_Name").alias("gene"), F.col("e.LOF_Number_of_transcripts_in_gene").alias("transcripts"),
                    F.col("e.LOF_Percent_of_transcripts_affected").alias("affected"))


@query("piped_lists", f"""{V} SELECT k, brand AS gene, 'G' || (k % 30) AS id FROM v""")
def _(spark, sf):
    e = T.parsed(spark, sf).select("k", F.explode(A.piped_to_structs(info_value("LOF"), T.LOF_FIELDS, strip_parens=True)).alias("e"))
    return e.select("k", F.col("e.Gene_Name").alias("gene"), F.col("e.Gene_ID").alias("id"))


@query("ancestral_allele", f"""{V} SELECT k, CASE WHEN k % 2 = 0 THEN 'A' END AS aa, 'C' AS r, NULL::VARCHAR AS a, 'INS' AS kind FROM v""")
def _(spark, sf):
    e = T.parsed(spark, sf).select("k", F.explode(A.ancestral_allele(info_value("AAL"))).alias("e"))
    return e.select("k", F.col("e.AA_AA").alias("aa"), F.col("e.AA_REF").alias("r"), F.col("e.AA_ALT").alias("a"), F.col("e.AA_IndelType").alias("kind"))


@query("configured_mapping", f"""{V} SELECT k, CASE kind WHEN 'PROMO' THEN 'advert' WHEN 'SMALL' THEN 'little' ELSE kind END AS class_text, k % 2 = 0 AS novel, k % 7 AS allele_count,
 'fixed' AS origin, CASE WHEN k % 5 = 0 THEN 'rs' || k ELSE 'rs' || (k + 1) END AS best_id, 'ENSG' || k || '/Whole_Blood;ENSG' || (k + 2) || '/Brain_' || (k % 8) AS pairs FROM v""")
def _(spark, sf):
    register_parser("gene_tissue", A.zip_gtex)
    out = apply_mapping(T.parsed(spark, sf), [
        FieldMapping("class_code", "class_text", values={"PROMO": "advert", "SMALL": "little"}),
        FieldMapping("NOVEL", "novel", exists_only=True),
        FieldMapping("AC", "allele_count", "integer"),
        FieldMapping("absent", "origin", default="fixed"),
        FieldMapping("avsnp147", "best_id"),
        FieldMapping("snp138", "old_id", overwrites="avsnp147"),
        FieldMapping("GTEx_V6_gene", nested_path="pairs", parse_function="gene_tissue", parse_with="GTEx_V6_tissue"),
    ])
    pairs = F.array_join(F.transform("pairs", lambda e: F.concat_ws("/", e["GTEx_V6_gene"], e["GTEx_V6_tissue"])), ";")
    return out.select("k", "class_text", F.coalesce("novel", F.lit(False)).alias("novel"), F.get("allele_count", F.lit(0)).alias("allele_count"), "origin", "best_id", pairs.alias("pairs"))


@query("map_values", """SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'advert' WHEN 'LARGE' THEN 'big' ELSE p_type END AS p_type FROM part""")
def _(spark, sf):
    return D.table(spark, sf, "part").select("p_partkey", map_values("p_type", {"PROMO": "advert", "LARGE": "big"}).alias("p_type"))


@query("map_values_table", """SELECT o_orderkey, coalesce(c_name, o_custkey::VARCHAR) AS customer FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""")
def _(spark, sf):
    names = D.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("value"), F.col("c_name").alias("mapped"))
    orders = D.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"))
    return map_values_table(orders, "customer", names)


# --- rejects and counters ------------------------------------------------------------------


@query("split_rejects", f"""{V} SELECT reason, count(*) AS n FROM (SELECT CASE k % 50 WHEN 1 THEN 'POS is not a number' WHEN 2 THEN 'QUAL is not a number'
 WHEN 4 THEN 'fewer than 8 columns' END AS reason FROM v) WHERE reason IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    _, bad = split_rejects(split_lines(T.lines(spark, sf, broken=True)))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("ingest_report", f"""{V} SELECT count(*) AS processed, count_if(k % 50 NOT IN (1, 2, 3, 4) AND kind <> 'PROMO')::BIGINT AS created, count_if(k % 50 NOT IN (1, 2, 3, 4) AND kind = 'PROMO')::BIGINT AS updated,
 count_if(k % 50 IN (1, 2, 4))::BIGINT AS failed, count_if(k % 50 = 3)::BIGINT AS skipped FROM v""")
def _(spark, sf):
    stored = normalize_variants(T.parsed(spark, sf).filter(info_value("class_code") == "PROMO")).select("variant_key")
    # The stored keys were made with chromosome names as they are.
    return ingest_report(split_lines(T.lines(spark, sf, broken=True)), stored, plain_chrom=False)

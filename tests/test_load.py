"""Whole loads from small files written by the tests."""

import gzip

import pytest
from pyspark.sql import functions as F

from helixloom.functions import vocab as V
from helixloom.operators import genotypes as N
from helixloom.operators import info as Info
from helixloom.plans.load import load_vcf
from helixloom.plans.spec import Attribute, FieldFilter, QuerySpec, run_spec, run_spec_nested, search_mode
from helixloom.sources import vcf, warehouse
from helixloom.sources.pedigree import read_ped

HEADER = """##fileformat=VCFv4.2
##INFO=<ID=AC,Number=A,Type=Integer,Description="Allele count, alternate">
##INFO=<ID=AF,Number=A,Type=Float,Description="Frequency">
##INFO=<ID=MQ,Number=1,Type=String,Description="Declared wrongly">
##INFO=<ID=DB,Number=0,Type=Flag,Description="In dbSNP">
##INFO=<ID=NEW,Number=0,Type=Flag,Description="New">
##INFO=<ID=Note,Number=1,Type=String,Description="Free text">
##INFO=<ID=gnomAD_all,Number=1,Type=String,Description="Frequency kept as text">
##INFO=<ID=CSQ,Number=.,Type=String,Description="Consequence annotations from Ensembl VEP. Format: Allele|Consequence|SYMBOL|SIFT|gnomAD_AF">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Depths">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">
##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Quality">
##FORMAT=<ID=PL,Number=G,Type=Integer,Description="Likelihoods">
##contig=<ID=1,length=249250621,assembly=hg19>
"""
COLUMNS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tKID\tDAD\tMUM\tSIS\n"
LINES = [
    # A de novo variant; repeated AC, escapes, a flag, two transcripts of which one is loss-of-function.
    "1\t100\trs7\tA\tG\t.\tPASS\tAC=1;AF=nan;AC=2;NEW;MQ=5;Note=a\\x3db\\x3bc=d;gnomAD_all=0.1;CSQ=G|missense_variant&intron_variant|G1|tolerated(0.12)|0.01,G|stop_gained|G2|0.9|\tGT:AD:DP:GQ:PL\t0/1:3,4:7:50:1,2,3\t0/0:9,0:9:60:0,1,2\t0/0:8,0:8:61:0,1,2\t0/0:1,1:2:3:4,5,6",
    # Recessive and loss-of-function.
    "1\t200\t.\tA\tACGTACGTACGTA\t50\tq10;s50\tAC=1;AF=0.5;MQ=5.5;CSQ=G|frameshift_variant|G1||\tGT:AD\t1/1:0,9\t0/1:4,5\t1|0:4,5\t./.:0,0",
    # A mother without call, a sister of an unknown form, AF infinite.
    "X\t3000000\tid3\tC\tT\t10\tPASS\tAC=.;AF=inf;MQ=6;CSQ=T|stop_gained|GX||\tGT:DP\t1:4\t0:5\t.|.:0\t./0:9",
    "1\tbad\t.\tA\tG\t1\tPASS\tAC=1\tGT\t0/1\t0/0\t0/0\t0/0",
    "1\t300\t.\tA\tG\thigh\tPASS\tAC=1\tGT\t0/1\t0/0\t0/0\t0/0",
    "1\t400\t.\tA",
]
PED = "#family sample father mother sex phenotype\nF KID DAD MUM 1 2 11 SIS 2 9 -9 NA NA\nF\tDAD\t-9\t-9\t1\t1\nF\tMUM\tNA\tNA\t2\t1\nF SIS DAD MUM 2 2\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("vcf")
    text = HEADER + COLUMNS + "\n".join(LINES) + "\n"
    (d / "cohort.vcf").write_text(text)
    with gzip.open(d / "cohort.vcf.gz", "wt") as f:
        f.write(text)
    (d / "cohort.ped").write_text(PED)
    return d


@pytest.fixture(scope="module")
def loaded(spark, files):
    return load_vcf(spark, str(files / "cohort.vcf"), read_ped(spark, str(files / "cohort.ped")))


def test_catalog(spark, files):
    c = vcf.read_catalog(spark, str(files / "cohort.vcf"))
    assert c.samples == ["KID", "DAD", "MUM", "SIS"] and c.contigs == {"1": 249250621}
    assert c.info["gnomAD_all"] == "float" and c.info["DB"] == "flag" and c.format["PL"] == "string"
    assert c.csq_fields == ["Allele", "Consequence", "SYMBOL", "SIFT", "gnomAD_AF"]
    assert c.descriptions["AC"] == "Allele count, alternate"


def test_gzip_equals_plain(spark, files):
    plain, packed = vcf.read_vcf(spark, str(files / "cohort.vcf")), vcf.read_vcf(spark, str(files / "cohort.vcf.gz"), partitions=3)
    assert sorted(plain.collect()) == sorted(packed.collect()) and plain.count() == 6
    assert vcf.read_catalog(spark, str(files / "cohort.vcf.gz")).samples == ["KID", "DAD", "MUM", "SIS"]


def test_profile_takes_the_widest_type(spark, files):
    raw, _ = vcf.split_rejects(vcf.read_vcf(spark, str(files / "cohort.vcf")))
    c = vcf.read_catalog(spark, str(files / "cohort.vcf"))
    refined = Info.refine_catalog(c, Info.profile_fields(raw, c.csq_fields).collect())
    assert refined.info["MQ"] == "float" and refined.info["AC"] == "integer" and refined.info["NEW"] == "flag"


def test_pedigree(spark, files, tmp_path):
    rows = {r["sample"]: r.asDict() for r in read_ped(spark, str(files / "cohort.ped")).collect()}
    assert rows["KID"]["father"] == "DAD" and rows["KID"]["affected_sibs_id"] == "SIS" and rows["KID"]["unaffected_sibs_id"] is None
    assert rows["DAD"]["father"] is None and rows["SIS"]["age"] is None
    (tmp_path / "bad.ped").write_text("F KID DAD\n")
    with pytest.raises(Exception, match="6 or 13"):
        read_ped(spark, str(tmp_path / "bad.ped")).collect()


def test_variants(loaded):
    tables, rejects = loaded
    v = {r["POS"]: r.asDict() for r in tables.base.collect()}
    assert set(v) == {100, 200, 3000000}
    a = v[100]
    assert a["QUAL"] == 100.0 and a["AC"] == 2 and a["AF"] is None and a["NEW"] == "Yes" and a["Note"] == "a=b;c=d" and a["dbSNP_ID"] == ["rs7"]
    assert a["MQ"] == 5.0 and a["gnomAD_all"] == 0.1 and a["gnomAD_AF"] == [0.01] and a["loss_of_function"]
    assert v[200]["Variant"] == "1_200_A_ACGTACGTAC" and v[200]["FILTER"] == ["q10", "s50"] and v[200]["VariantType"] == "INDEL" and v[200]["NEW"] == "No"
    assert v[3000000]["AF"] == 999.99 and v[3000000]["AC"] is None and v[3000000]["ID"] == "id3" and v[3000000]["dbSNP_ID"] is None
    assert sorted(r["reason"] for r in rejects.collect()) == ["POS is not a number", "QUAL is not a number", "fewer than 8 columns"]


def test_consequences(loaded):
    rows = loaded[0].paths["CSQ_nested"].filter("POS = 100").orderBy("SYMBOL").collect()
    assert [(r["Consequence"], r["SYMBOL"], r["SIFT_pred"], r["SIFT_score"]) for r in rows] == [
        (["missense_variant", "intron_variant"], "G1", "tolerated", 0.12), (["stop_gained"], "G2", None, 0.9)]


def test_genotypes_and_modes(loaded):
    g = {(r["POS"], r["Sample_ID"]): r.asDict() for r in loaded[0].paths["sample"].collect()}
    kid = g[(100, "KID")]
    assert (kid["GT"], kid["AD_ref"], kid["AD_alt"], kid["DP"], kid["GQ"], kid["PL"]) == ("0/1", 3, 4, 7, 50, "1,2,3")
    assert (kid["Father_Genotype"], kid["Mother_Genotype"], kid["Affected_Siblings_Genotypes"], kid["Age"]) == ("0/0", "0/0", "0/0", "11")
    assert kid["mendelian_diseases"] == ["denovo"] and g[(200, "KID")]["mendelian_diseases"] == ["autosomal_recessive"]
    # The mother's missing call is seen by the child although her own row is dropped.
    x = g[(3000000, "KID")]
    assert x["Mother_Genotype"] == ".|." and (3000000, "MUM") not in g and (200, "SIS") not in g and (3000000, "SIS") in g
    assert g[(200, "KID")]["Affected_Siblings_Genotypes"] == "./."


def test_without_pedigree_reference_calls_are_dropped(spark, files):
    tables, _ = load_vcf(spark, str(files / "cohort.vcf"), profile=False)
    assert sorted((r["POS"], r["Sample_ID"]) for r in tables.paths["sample"].collect()) == [
        (100, "KID"), (200, "DAD"), (200, "KID"), (200, "MUM"), (3000000, "KID"), (3000000, "SIS")]


def test_in_line_pedigree_agrees_with_the_join(spark, files):
    raw, _ = vcf.split_rejects(vcf.read_vcf(spark, str(files / "cohort.vcf")))
    ped = read_ped(spark, str(files / "cohort.ped"))
    samples, types = ["KID", "DAD", "MUM", "SIS"], {"DP": "integer", "GQ": "integer", "PL": "string"}
    joined = N.drop_uncalled(N.join_pedigree(N.unpivot_genotypes(raw, samples, ["POS"], types, nocall="keep"), ped, ["POS"], siblings=True))
    in_line = N.unpivot_with_pedigree(raw, samples, ["POS"], ped, types, siblings=True)
    assert sorted(map(str, joined.select(*sorted(joined.columns)).collect())) == sorted(map(str, in_line.select(*sorted(joined.columns)).collect()))
    assert "Exchange hashpartitioning" not in in_line._jdf.queryExecution().executedPlan().toString()


def test_warehouse_round_trip_and_pruning(spark, loaded, tmp_path):
    tables, _ = loaded
    warehouse.write_tables(tables, str(tmp_path / "w"))
    back = warehouse.read_tables(spark, str(tmp_path / "w"), list(tables.paths))
    assert sorted(r["Variant"] for r in back.base.collect()) == sorted(r["Variant"] for r in tables.base.collect())
    assert back.paths["sample"].count() == tables.paths["sample"].count()
    hit = vcf.region(back.base, "1", 150, 250)
    assert [r["POS"] for r in hit.collect()] == [200]
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(CHROM" in plan and "GreaterThanOrEqual(POS,150)" in plan
    key = back.base.filter("POS = 100").first()["variant_key"]
    assert warehouse.get_variant(back.base, key).first()["POS"] == 100


def test_search_on_loaded_tables(loaded):
    tables, _ = loaded
    attributes = [Attribute("Variant"), Attribute("Sample_ID", "sample"), Attribute("GT", "sample"), Attribute("SYMBOL", "CSQ_nested")]
    filters = [FieldFilter("filter_range_gte", "POS", "150"), FieldFilter("nested_filter_terms", "GT", "1/1\n1", path="sample"),
               FieldFilter("nested_filter_terms", "Consequence", "stop_gained\nframeshift_variant", path="CSQ_nested")]
    spec = QuerySpec(attributes, filters)
    rows = run_spec(tables, spec).collect()
    assert [(r["Variant"], r["Sample_ID"], r["GT"], r["SYMBOL"]) for r in sorted(rows, key=lambda r: r["Variant"])] == [
        ("1_200_A_ACGTACGTAC", "KID", "1/1", "G1"), ("X_3000000_C_T", "KID", "1", "GX")]
    docs = tables.base
    for p in ("sample", "CSQ_nested"):
        docs = docs.join(N.sample_arrays(tables.paths[p].drop("CHROM", "POS"), ["variant_key"], p), "variant_key", "left")
    assert sorted(run_spec_nested(docs, spec).collect()) == sorted(rows)
    found = search_mode(tables, "autosomal_recessive", QuerySpec(attributes)).collect()
    assert [(r["Variant"], r["Sample_ID"]) for r in found] == [("1_200_A_ACGTACGTAC", "KID")]


def test_element_scans_are_pruned_by_shared_columns(spark, loaded, tmp_path):
    tables, _ = loaded
    warehouse.write_tables(tables, str(tmp_path / "w"))
    back = warehouse.read_tables(spark, str(tmp_path / "w"), list(tables.paths))
    spec = QuerySpec([Attribute("Variant"), Attribute("Sample_ID", "sample"), Attribute("GT", "sample")], [
        FieldFilter("filter_term", "CHROM", "1"), FieldFilter("filter_range_gte", "POS", "150"), FieldFilter("nested_filter_terms", "GT", "1/1", path="sample")])
    found = run_spec(back, spec)
    scans = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x]
    assert len(scans) == 2 and all("CHROM" in x.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(POS,150)" in x for x in scans)
    assert [(r["Variant"], r["Sample_ID"]) for r in found.collect()] == [("1_200_A_ACGTACGTAC", "KID")]


def test_files_name_their_own_samples(spark, tmp_path):
    top = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    (tmp_path / "a.vcf").write_text(top + "S1\tS2\n1\t10\t.\tA\tC\t1\tPASS\tAC=1\tGT\t0/1\t1/1\n1\t11\t.\tA\tC\t1\tPASS\tAC=1\tGT\t0/1\n")
    (tmp_path / "b.vcf").write_text(top + "S9\tS2\tS7\n1\t20\t.\tA\tC\t1\tPASS\tAC=1\tGT\t0/1\t0|1\t1/1\n")
    tables, bad = load_vcf(spark, f"{tmp_path}/*.vcf", profile=False)
    got = sorted((r["POS"], r["Sample_ID"], r["GT"]) for r in tables.paths["sample"].collect())
    assert got == [(10, "S1", "0/1"), (10, "S2", "1/1"), (20, "S2", "0|1"), (20, "S7", "1/1"), (20, "S9", "0/1")]
    assert [r["reason"] for r in bad.collect()] == ["number of calls differs from the heading"]
    (tmp_path / "c.vcf").write_text("1\t30\t.\tA\tC\t1\tPASS\tAC=1\tGT\t0/1\n")
    for path in (f"{tmp_path}/*.vcf", f"{tmp_path}/c.vcf"):
        with pytest.raises(ValueError, match="no #CHROM heading"):
            load_vcf(spark, path, profile=False)


def test_report_meets_stored_keys_of_the_load(spark):
    raw = vcf.split_lines(spark.createDataFrame([("chrX\t5\t.\tA\tC\t1\tPASS\tAC=1\tGT\t0/1",)], "value string"))
    keyed = raw.withColumn("CHROM", vcf.normalize_chrom("CHROM"))
    for parts in ((), ("ds",)):
        known = vcf.normalize_variants(keyed, key_parts=parts).select("variant_key")
        assert vcf.ingest_report(raw, known, key_parts=parts).first()["updated"] == 1


def test_mode_search_asks_for_loss_of_function_on_any_transcript(spark):
    base = spark.createDataFrame([("v", "1", 5)], "variant_key string, CHROM string, POS int")
    csq = spark.createDataFrame([("v", "G1", ["missense_variant"]), ("v", "G2", ["stop_gained"])], "variant_key string, SYMBOL string, Consequence array<string>")
    rows = spark.createDataFrame([("v", "KID", ["autosomal_recessive"])], "variant_key string, Sample_ID string, mendelian_diseases array<string>")
    spec = QuerySpec([Attribute("SYMBOL", "CSQ_nested"), Attribute("Sample_ID", "sample")], [FieldFilter("nested_filter_term", "SYMBOL", "G1", path="CSQ_nested")])
    found = search_mode(warehouse.Tables(base, {"CSQ_nested": csq, "sample": rows}), "autosomal_recessive", spec)
    assert [(r["SYMBOL"], r["Sample_ID"]) for r in found.collect()] == [("G1", "KID")]


def test_pedigree_join_reads_the_genotypes_twice(spark, files):
    g = spark.read.parquet(_stored_genotypes(spark, files))
    joined = N.join_pedigree(g, read_ped(spark, str(files / "cohort.ped")), ["POS"], siblings=True)
    assert joined._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2


def _stored_genotypes(spark, files):
    raw, _ = vcf.split_rejects(vcf.read_vcf(spark, str(files / "cohort.vcf")))
    path = str(files / "genotypes")
    N.unpivot_genotypes(raw, ["KID", "DAD", "MUM", "SIS"], ["POS"], {"DP": "integer"}, nocall="keep").write.mode("overwrite").parquet(path)
    return path


def test_mapping_joins_different_members_on_one_path(spark):
    from helixloom.functions.parsers import register_parser

    register_parser("_one", lambda c: F.array(F.struct(c.alias("A"))))
    register_parser("_two", lambda c: F.array(F.struct(c.alias("B"), F.lit(1).alias("n"))))
    df = spark.createDataFrame([("x=1;y=2",)], "INFO string")
    out = Info.apply_mapping(df, [Info.FieldMapping("x", parse_function="_one", nested_path="p"), Info.FieldMapping("y", parse_function="_two", nested_path="p")]).first()
    assert [tuple(e) for e in out["p"]] == [("1", None, None), (None, "2", 1)]


def test_schema_from_catalog(spark, files):
    c = vcf.read_catalog(spark, str(files / "cohort.vcf"))
    s = warehouse.warehouse_schema(c, "vep", ped=True)
    assert "DB" not in s.names and "CSQ" not in s.names and "Father_Genotype" in s["sample"].dataType.elementType.names
    assert {"SIFT_pred", "SIFT_score"} <= set(s["CSQ_nested"].dataType.elementType.names)
    cc = warehouse.warehouse_schema(c, case_control=True)
    assert {"AC_case", "AC_control", "QUAL_case", "FILTER_control"} <= set(cc.names) and "AC" not in cc.names
    ann = warehouse.warehouse_schema(c, "annovar")
    assert "AAChange_refGene" in ann.names and "Distance_to_upstream_ensGene" in ann.names


def test_case_control_files(spark, files):
    from helixloom.operators import merging as M

    raw, _ = vcf.split_rejects(vcf.read_vcf(spark, str(files / "cohort.vcf")))
    v = Info.parse_info(vcf.normalize_variants(raw), {"AC": "integer"}).select("CHROM", "POS", "REF", "ALT", "QUAL", "FILTER", "AC", "ID")
    merged = M.merge_case_control(v.filter("POS <> 200"), v.filter("POS <> 100")).orderBy("POS").collect()
    assert [(r["POS"], r["AC_case"], r["AC_control"], r["QUAL_case"]) for r in merged] == [(100, 2, None, 100.0), (200, None, 1, None), (3000000, None, None, 10.0)]


def test_vocabulary_is_consistent():
    assert set(V.LOF_MODES) <= set(V.MODES) and len(set(V.MODES)) == 7

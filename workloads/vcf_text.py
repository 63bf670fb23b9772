"""Annotated VCF text written from the part table, and the SQL of what it says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.operators.info import with_info
from helixloom.operators.sizing import spread
from helixloom.sources.vcf import split_lines
from workloads import derive as D

CSQ_FIELDS = ["Allele", "Consequence", "IMPACT", "SYMBOL", "Gene", "cDNA_position", "SIFT", "PolyPhen", "DISTANCE",
              "Existing_variation", "gnomAD_AF", "CLIN_SIG", "VARIANT_CLASS"]
CSQ_TYPES = {"DISTANCE": "integer", "cDNA_position": "integer", "gnomAD_AF": "float"}
ANN_FIELDS = ["Allele", "Annotation", "Annotation_Impact", "Gene_Name", "cDNA.pos / cDNA.length", "Distance", "ERRORS / WARNINGS / INFO"]
LOF_FIELDS = ["Gene_Name", "Gene_ID", "Number_of_transcripts_in_gene", "Percent_of_transcripts_affected"]
FUNCS = ["exonic", "UTR5", "intergenic", "upstream", "downstream", "intronic"]

INFO_TYPES = {"AC": "integer", "AF": "float", "AN": "integer", "DP": "integer", "FS": "integer", "DB": "flag", "NOVEL": "flag", "Note": "string",
              "snp138": "string", "avsnp147": "string", "class_code": "string", "vqs_score": "float"}


def text(*parts: Column | str) -> Column:
    shape = "".join(p.replace("%", "%%") if isinstance(p, str) else "%s" for p in parts)
    return F.format_string(shape, *[p for p in parts if not isinstance(p, str)])


def info(k: Column, brand: Column, kind: Column) -> Column:
    """INFO of one variant: plain fields with gaps, repeats and escapes, then annotations."""
    pct = F.lpad((k % 100).cast("string"), 2, "0")
    af = F.when(k % 11 == 0, "nan").when(k % 13 == 0, "inf").otherwise(text("0.", pct))
    func = F.element_at(F.lit(FUNCS), (k % 6 + 1).cast("int"))
    gene2 = text(brand, "\\x3b", "NEXT", k % 10)
    detail = (F.when(k % 6 == 0, text("NM_", k, ":exon1:c.1A>G")).when(k % 6 == 1, text("NM_", k, ":c.-5A>G\\x3bNM_9:c.-7A>G"))
              .when(k % 6 == 2, text("dist\\x3d", k, "\\x3bdist\\x3d", F.when(k % 4 == 0, "NONE").otherwise((k + 5).cast("string"))))
              .when(k % 6 == 3, text("dist\\x3d", k % 700)).when(k % 6 == 4, text("dist\\x3d", k % 800)).otherwise(F.lit(".")))
    csq1 = text("A|missense_variant&splice_region_variant|MODERATE|", brand, "|ENSG", k, "|", k % 90, "-", k % 90 + 3,
                "|tolerated(0.", pct, ")|benign(0.3)||rs", k, "&COSM", k % 77, "|0.", pct, "|benign&risk_factor|", kind)
    csq2 = text("A|", F.when(k % 3 == 0, "stop_gained").otherwise("intron_variant"), "|HIGH|", brand, "b|ENSG", k + 1, "|?-", k % 90 + 1, "||0.9|",
                k % 400, "||||", kind)
    fields = [
        text("AC=", k % 7), text("AF=", af), text("AN=1"), F.when(k % 9 == 0, "DP=.").otherwise(text("DP=", k % 500)), text("FS=", k % 3),
        F.lit("DB"), F.when(k % 2 == 0, "NOVEL"), text("Note=a\\x3d", k % 5, "\\x3bb"), F.when(k % 5 == 0, text("snp138=rs", k)),
        text("avsnp147=rs", k + 1), text("class.code=", kind), text("vqs_score=", F.when(k % 4 == 0, "1e2").otherwise("x")), text("AN=", k % 40),
        text("CSQ=", csq1, ",", csq2), text("Func.refGene=", func), text("Gene.refGene=", gene2), text("GeneDetail.refGene=", detail),
        text("AAChange.refGene=", F.when(k % 8 == 0, "UNKNOWN").otherwise(text(
            brand, ":NM_", k, ":exon", k % 9, ":c.A", k % 99, "G:p.K", k % 33, "R,", brand, ":NM_x:exon2,OTHER:NM_y:exon3:c.T5A:p.L2M"))),
        text("CLNSIG=Pathogenic|", F.when(k % 2 == 0, "Benign").otherwise("Uncertain")), text("CLNDN=dis", k % 6, "|dis", k % 7),
        text("CLNREVSTAT=single|", F.when(k % 3 == 0, "multi").otherwise("none")),
        text("cosmic70=ID\\x3dCOSM", k, ",COSM", k + 1, "\\x3bOCCURENCE\\x3d", k % 9, "(lung),", k % 4, "(skin)"),
        text("ICGC_Occurrence=LIVER-", k % 3, "|", k % 12, "|", k % 12 + 100, "|0.", pct, ",SKIN|1|200|0.005"),
        text("GTEx_V6_gene=ENSG", k, "|ENSG", k + 2), text("GTEx_V6_tissue=Whole_Blood|Brain_", k % 8),
        text("gwasCatalog=Name\\x3dHeight,_Weight_", k % 10), text("tfbsConsSites=Score\\x3d", k % 1000, "\\x3bName\\x3dV$E", k % 15),
        text("wgRna=Name\\x3dmir-", k % 21),
        text("ANN=A|missense&stop|HIGH|", brand, "|", k % 60 + 1, "/", k % 60 + 100, "|", k % 10, "|W1&W2,A|syn|LOW|", brand, "c|||"),
        text("LOF=(", brand, "|G", k % 30, "|", k % 5 + 1, "|0.", pct, ")"), text("AAL=", F.when(k % 2 == 0, "A").otherwise("."), "|C|.|INS"),
    ]
    return F.concat_ws(";", *fields)


def lines(spark: SparkSession, sf: str, broken: bool = False) -> DataFrame:
    """One VCF data line per part, with the whole cohort's sample columns.

    ``broken`` spoils some lines: a bad POS, a bad QUAL, too few columns, or all calls missing.
    """
    k = F.col("variant_key")
    v = spread(D.variants(spark, sf))
    ident = F.when(k % 3 == 0, text("rs", k)).when(k % 3 == 1, ".").otherwise(text("id", k))
    qual = F.when(k % 10 == 0, ".").otherwise((k % 90 + 0.5).cast("string"))
    filt = F.when(k % 4 == 0, "PASS").when(k % 4 == 1, "q10;s50").otherwise("q10")
    pos = F.col("POS").cast("string")
    samples = D.calls(k)
    if broken:
        pos = F.when(k % 50 == 1, "x1").otherwise(pos)
        qual = F.when(k % 50 == 2, "high").otherwise(qual)
        samples = F.when(k % 50 == 3, F.transform(samples, lambda _: F.lit("./."))).otherwise(samples)
    head = [text("chr", F.col("CHROM")), pos, ident, F.col("REF"), F.col("ALT"), qual, filt, info(k, F.col("gene"), F.col("p_type")), F.lit("GT:AD:DP:GQ")]
    line = F.concat_ws("\t", *head, F.array_join(samples, "\t"))
    if broken:
        line = F.when(k % 50 == 4, F.concat_ws("\t", *head[:5])).otherwise(line)
    # A one-element explode keeps the optimizer from copying the text into every later filter.
    return v.select(F.explode(F.array(line)).alias("value"))


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    """The text split again, with the part's number read back from the position."""
    raw = split_lines(lines(spark, sf)).drop("_line")
    return with_info(raw.withColumn("k", (F.col("POS").cast("long") / 20000).cast("long")))


def header(spark: SparkSession, sf: str) -> DataFrame:
    """Header lines naming what the parts hold: one INFO field per type, one contig per chromosome."""
    fields = D.table(spark, sf, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).select(text(
        "##INFO=<ID=", F.col("p_type"), ".score,Number=1,Type=String,Description=\"", F.col("n"), " parts\">").alias("value"))
    brands = D.table(spark, sf, "part").select("p_brand").distinct().select(text(
        "##INFO=<ID=", F.replace("p_brand", F.lit("#"), F.lit(".")), ",Number=.,Type=Integer,Description=\"a|b\">").alias("value"))
    contigs = D.variants(spark, sf).groupBy("CHROM").agg(F.max("POS").alias("n")).select(text(
        "##contig=<ID=", F.col("CHROM"), ",length=", F.col("n"), ",assembly=hg19>").alias("value"))
    csq = D.table(spark, sf, "region").select(text(
        "##FORMAT=<ID=PL", F.col("r_regionkey"), ",Number=G,Type=Integer,Description=\"Likelihoods of ", F.col("r_name"), "\">").alias("value"))
    return fields.unionByName(brands).unionByName(contigs).unionByName(csq)

"""Which filters a field offers: rules over a field catalog, first match wins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field names by group, panel names and filter kinds.
CHOICE_FIELDS = ["CHROM", "FILTER", "cytoBand"]
POSITION_FIELDS = ["POS", "END", "MLEN", "MEND", "MSTART", "SVLEN", "CIPOS", "CIEND"]
FLAG_CHOICES = ["EX_TARGET", "IMPRECISE", "MULTI_ALLELIC"]
ID_FIELDS = ["dbSNP_ID", "COSMIC_ID", "snp138NonFlagged", "ICGC_ID"]
VARIANT_FIELDS = [
    "Variant", "CHROM", "POS", "ID", "REF", "ALT", "VariantType", "cytoBand", "SVTYPE", "SVLEN", "END", "MLEN", "TSD", "IMPRECISE",
    "MULTI_ALLELIC", "MEINFO", "MSTART", "MEND", "EX_TARGET", "CIPOS", "CIEND", "dbSNP_ID",
]
QUALITY_FIELDS = [
    "QUAL", "FILTER", "OND", "HRun", "ABHom", "ABHet", "ExcessHet", "RAW_MQ", "InbreedingCoeff", "MQRankSum", "MQ0", "BaseQRankSum",
    "HWP", "FS", "ClippingRankSum", "MQ", "QD", "ReadPosRankSum", "HaplotypeScore", "VQSLOD", "SOR",
]
STATISTICS_FIELDS = ["AC", "AF", "AN", "MLEAC", "MLEAF", "GQ_MEAN", "GQ_STDDEV"]
SAMPLE_CHOICES = [
    "Sample_ID", "Family_ID", "Father_ID", "Mother_ID", "Sex", "GT", "PGT", "Phenotype", "Father_Phenotype", "Mother_Phenotype",
    "Father_Genotype", "Mother_Genotype", "group", "mendelian_diseases",
]
FREQUENCY_PATTERN = r"gnomAD_|ExAC_|1000g2015aug_|1000Gp3|esp6500|ESP6500|nci60|^Kaviar|_AF|_AC|_nhomalt$|_AN$"
THOUSAND_GENOMES = ["MAX_AF", "AA_AF", "EA_AF", "EUR_AF", "AFR_AF", "EAS_AF", "ERR_AF", "AMR_AF", "SAS_AF"]
CONSEQUENCE_PATTERN = r"^(Func|ExonicFunc)_(refGene|ensGene)$"
CODING_CHANGE_PATTERN = r"^(exon_id|cdna_change|aa_change)_(rg|eg)$"
NONCODING_PATTERN = r"^(Gene|Upstream|Downstream|GeneDetail)_(refGene|ensGene)$"
DISTANCE_PATTERN = r"^Distance_to_(up|down)stream_(refGene|ensGene)$"
PREDICTION_PATTERN = r"(_pred|_prediction|_Prediction|_pred_coding|_pred_transf)$"
SCORE_PATTERN = r"(_score|_Score|_SCORE|_rankscore|_phred|_PHRED|_raw|_RAW|_RawScore|_RS)$"
CONSERVATION_PATTERN = r"^(phastCons|phyloP|PhastCons|PhyloP|SiPhy|tfbsConsSites|targetScanS|wgRna)"
INTERVAR_FIELDS = [
    "InterVar_automated", "PVS1", "PS1", "PS2", "PS3", "PS4", "PM1", "PM2", "PM3", "PM4", "PM5", "PM6", "PP1", "PP2", "PP3", "PP4", "PP5",
    "BA1", "BS1", "BS2", "BS3", "BS4", "BP1", "BP2", "BP3", "BP4", "BP5", "BP6", "BP7",
]
# Flat fields that are stored but never offered as filters.
NOT_OFFERED = [
    "targetScanS", "tfbsConsSites", "RGQ", "cosmic_70", "sample", "avsnp147", "avsnp150", "PR", "Status", "integrated_confidence_value", "MCAP",
    "Codon_sub", "Eigen_coding_or_noncoding", "OXPHOS_Complex", "Gene_pos", "AAChange_refGene", "AAChange_ensGene", "CSQ_nested",
    "Class_predicted", "culprit", "US", "Presence_in_TD", "Prob_N", "Prob_P", "Mutation_frequency", "AA_pos", "AA_sub", "CCC", "CCC_case",
    "CCC_control", "CSQ", "DB", "MQ0", "ANNOVAR_DATE", "CADD_prediction", "Associated_disease", "CLNDISDB", "CS", "EFIN_HumDiv_Prediction",
    "Ensembl_Protein_ID", "Examined_samples", "Gene_ensGene", "Gene_refGene", "Gene_symbol", "ICGC_Occurrence", "MC", "Mean_MI_score",
    "MutAss_prediction", "NCBI_Gene_ID", "NCBI_Protein_ID", "NS", "OLD_VARIANT", "Perc_coevo_Sites", "PolyPhen2_prediction", "PolyPhen2_score",
    "SIFT_prediction", "SiteVar", "VT", "cosmic70", "Tumor_site", "DP", "NEGATIVE_TRAIN_SITE", "POSITIVE_TRAIN_SITE", "DS", "DS_case",
    "DS_control", "ALLELE_END", "NCC", "NCC_case", "NCC_control",
]
DISEASE_PATTERN = r"^(CLN|CLIN|clinvar|COSMIC|ICGC|gwasCatalog|PUBMED|PHENO|snp138NonFlagged)"


@dataclass(frozen=True)
class Rule:
    panel: str
    when: Column
    filters: tuple[tuple[str, bool], ...]
    sub_panel: Column | str = ""


def _rules() -> list[Rule]:
    f, path = F.col("field"), F.col("path")
    flat, numeric = path.isNull(), F.col("type").isin("integer", "float")
    both = (("filter_range_gte", False), ("filter_range_lte", False))
    bare = F.regexp_replace(f, "_(case|control)$", "")
    annotated = path.isNotNull() & (path != "sample")
    frequency = F.when(f.rlike("_(AC|AN)$"), "Allele Count/Number").when(f.rlike("1000g2015aug_|1000Gp3") | f.isin(THOUSAND_GENOMES), "1000 Genomes") \
        .when(f.contains("ExAC_"), "ExAC").when(f.rlike("(?i)esp6500"), "Exome Sequencing Project").when(f.contains("gnomAD"), "gnomAD").otherwise("")
    model = F.when(f.contains("ensGene"), "Ensembl").when(f.contains("refGene"), "NCBI").otherwise("Other")
    source = F.when(f.startswith("CLN"), "CLINVAR").when(f.startswith("COSMIC"), "COSMIC").when(f.startswith("ICGC"), "ICGC").otherwise("")
    variant, quality, maf = "Variant Related Information", "Variant Quality Metrix", "Minor Allele Frequency (MAF)"
    sample, gene, disease, harm = "Sample Related Information", "Gene Related Information", "Disease Associations", "Pathogenicity Predictions"
    listed = (("filter_terms", False), ("filter_exists", False))
    return [
        Rule(sample, (path == "sample") & f.isin(SAMPLE_CHOICES), (("nested_filter_terms", True),)),
        Rule(sample, (path == "sample") & (f == "PL"), (("nested_filter_term", False),)),
        Rule(sample, (path == "sample") & numeric, (("nested_filter_range_gte", False),)),
        Rule(sample, path == "sample", (("nested_filter_term", False),)),
        Rule(variant, flat & f.isin(CHOICE_FIELDS), (("filter_terms", True),)),
        Rule(variant, flat & f.isin("VariantType", "SVTYPE"), (("filter_term", True),)),
        Rule(variant, flat & f.isin(FLAG_CHOICES), (("filter_terms", True),)),
        Rule(variant, flat & f.isin(POSITION_FIELDS), both),
        Rule(variant, flat & (f == "dbSNP_ID"), listed),
        Rule(variant, flat & f.isin(VARIANT_FIELDS), (("filter_term", False),)),
        Rule(quality, flat & (bare == "QUAL"), (("filter_range_gte", False),)),
        Rule(quality, flat & bare.isin(QUALITY_FIELDS) & numeric, both),
        Rule(quality, flat & bare.isin(QUALITY_FIELDS), (("filter_term", True),)),
        Rule("Summary Statistics Information", flat & bare.isin(STATISTICS_FIELDS) & numeric, both),
        Rule("Summary Statistics Information", flat & bare.isin(STATISTICS_FIELDS), (("filter_term", False),)),
        Rule(maf, flat & (f == "MAX_AF_POPS"), (("filter_term", True),), frequency),
        Rule(maf, flat & f.rlike("(_AC|_nhomalt|_AN)$"), both, frequency),
        Rule(maf, flat & f.rlike(FREQUENCY_PATTERN), (("filter_range_lt", False),), frequency),
        Rule("Functional Consequences", annotated & (f == "Consequence"), (("nested_filter_terms", True),)),
        Rule("Functional Consequences", flat & f.rlike(CONSEQUENCE_PATTERN), (("filter_terms", True),), model),
        Rule("Conservation", flat & f.rlike(CONSERVATION_PATTERN) & f.endswith("Name"), (("filter_term", True),), "Sites"),
        Rule("Conservation", flat & f.rlike(CONSERVATION_PATTERN), (("filter_range_gte", False),), "Scores"),
        Rule(disease, flat & f.isin(ID_FIELDS), listed, source),
        Rule(disease, f == "CLNALLELEID", (("filter_term", False),), source),
        Rule(disease, annotated & f.rlike(DISEASE_PATTERN) & numeric, (("nested_filter_range_gte", False),), source),
        Rule(disease, annotated & f.rlike(DISEASE_PATTERN), (("nested_filter_terms", True),), source),
        Rule(disease, flat & f.rlike(DISEASE_PATTERN), (("filter_terms", True),), source),
        Rule(disease, flat & f.isin(INTERVAR_FIELDS), (("filter_terms", True),), "ACMG/AMP InterVar Criteria"),
        Rule(harm, annotated & (f.rlike(PREDICTION_PATTERN) | (f == "IMPACT")), (("nested_filter_terms", True),), "Predictions"),
        Rule(harm, flat & f.rlike(PREDICTION_PATTERN), (("filter_terms", True),), "Predictions"),
        # A lower SIFT score is the more harmful one.
        Rule(harm, annotated & f.startswith("SIFT") & f.rlike(SCORE_PATTERN), (("nested_filter_range_lte", False),), "Scores"),
        Rule(harm, annotated & f.rlike(SCORE_PATTERN), (("nested_filter_range_gte", False),), "Scores"),
        Rule(harm, flat & f.startswith("SIFT") & f.rlike(SCORE_PATTERN), (("filter_range_lte", False),), "Scores"),
        Rule(harm, flat & f.rlike(SCORE_PATTERN), (("filter_range_gte", False),), "Scores"),
        Rule(gene, annotated & (f == "DISTANCE"), (("nested_filter_range_lte", False),)),
        Rule(gene, annotated & f.rlike(CODING_CHANGE_PATTERN), (("nested_filter_term", False),)),
        Rule(gene, annotated & f.isin("Feature_type", "BIOTYPE", "DOMAINS"), (("nested_filter_terms", True),)),
        Rule(gene, annotated, (("nested_filter_terms", False),)),
        Rule(gene, flat & f.rlike(DISTANCE_PATTERN), (("filter_range_lte", False),), model),
        Rule(gene, flat & f.rlike(NONCODING_PATTERN), (("filter_term", False),), model),
        Rule("Other", numeric, both),
        Rule("Other", F.lit(True), (("filter_term", False),)),
    ]


def schema_catalog(schema: T.StructType) -> list[tuple[str, str | None, str]]:
    """(field, path, type) of every flat field and array member of a document type."""
    def kind(t: T.DataType) -> str:
        t = t.elementType if isinstance(t, T.ArrayType) else t
        if isinstance(t, T.IntegralType):
            return "integer"
        return "float" if isinstance(t, T.FractionalType) else "boolean" if isinstance(t, T.BooleanType) else "keyword"

    out: list[tuple[str, str | None, str]] = []
    for f in schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            out += [(m.name, f.name, kind(m.dataType)) for m in f.dataType.elementType.fields]
        else:
            out.append((f.name, None, kind(f.dataType)))
    return out


def field_plan(catalog: DataFrame, facets: DataFrame | None = None) -> DataFrame:
    """One row per offered filter: field, path, type, panel, sub_panel, kind, choices.

    ``catalog`` has field, path, type; ``NOT_OFFERED`` fields get no filter. With ``facets`` (field, value, n) the fields that offer
    choices also say how many there are; the values themselves stay in the facet table.
    """
    catalog = catalog.filter(F.col("path").isNotNull() | ~F.col("field").isin(NOT_OFFERED))
    plan = None
    for r in reversed(_rules()):
        sub = r.sub_panel if isinstance(r.sub_panel, Column) else F.lit(r.sub_panel)
        offered = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("choices")) for k, c in r.filters])
        row = F.struct(F.lit(r.panel).alias("panel"), sub.alias("sub_panel"), offered.alias("filters"))
        plan = row if plan is None else F.when(r.when, row).otherwise(plan)
    out = catalog.select("field", "path", "type", plan.alias("p")).select(
        "field", "path", "type", "p.panel", "p.sub_panel", F.explode("p.filters").alias("f")).select(
        "field", "path", "type", "panel", "sub_panel", "f.kind", "f.choices")
    if facets is None:
        return out
    counts = facets.groupBy(F.col("field").alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
    named = F.when(F.col("path").isNull(), F.col("field")).otherwise(F.concat_ws(".", "path", "field"))
    return out.join(counts, named == F.col("_f"), "left").select(
        *out.columns, F.when(F.col("choices"), F.coalesce("_n", F.lit(0))).alias("values"))

"""Names, codes and coordinates shared by the operators.

Everything below is a fixed value: the results depend on these exact words and numbers.
"""

# Genotype strings, compared as text.
HET = ["0/1", "0|1", "1|0"]
HOM_REF = ["0/0", "0|0"]
HOM_ALT = ["1/1", "1|1"]
X_REF = ["0", "0/0", "0|0"]
X_MALE_DOMINANT = ["0/1", "0|1", "1|0", "1/1", "1|1", "1", "./1", ".|1", "1|."]
X_MALE_DENOVO = ["0/1", "0|1", "1|0", "1/1", "1|1", "1"]
X_FATHER_CARRIER = ["0/1", "0|1", "1|0", "1", "./1", ".|1", "1|."]
TRIO_HET = ["0/1", "0|1", "1/0", "1|0"]
NO_CALL_PREFIXES = [".|.", "./.", "0|.", ".|0", "0/."]
HOM_REF_PREFIXES = ["0/0", "0|0", "0:"]

# Pedigree codes.
UNAFFECTED = "1"
AFFECTED = "2"
MALE = "1"
FEMALE = "2"
PED_MISSING = ["-9", "NA"]
PED_COLUMNS = [
    "family", "sample", "father", "mother", "sex", "phenotype", "age",
    "affected_sibs_id", "affected_sibs_sex", "affected_sibs_age",
    "unaffected_sibs_id", "unaffected_sibs_sex", "unaffected_sibs_age",
]

# Terms that make a variant loss-of-function.
LOF_CONSEQUENCES = [
    "frameshift_variant", "splice_acceptor_variant", "splice_donor_variant", "start_lost",
    "start_retained_variant", "stop_gained", "stop_lost",
]
LOF_EXONIC = ["frameshift_deletion", "frameshift_insertion", "stopgain", "stoploss"]
LOF_FUNC = "splicing"

# Inheritance modes, in tagging order.
MODES = [
    "autosomal_recessive", "denovo", "autosomal_dominant", "x_linked_dominant",
    "x_linked_recessive", "x_linked_denovo", "compound_heterozygous",
]
LOF_MODES = ["autosomal_recessive", "compound_heterozygous", "x_linked_recessive"]

# Pseudo-autosomal intervals of chromosome X.
PAR = {
    "hg19": [(60001, 2699520), (154931044, 155260560)],
    "hg38": [(10001, 2781479), (155701383, 156030895)],
}

# INFO handling.
INFO_EXCLUDED = [
    "AA", "ANNOVAR_DATE", "MQ0", "DB", "POSITIVE_TRAIN_SITE", "NEGATIVE_TRAIN_SITE", "culprit",
]
COHORT_FIELDS = [
    "AC", "AF", "AN", "BaseQRankSum", "GQ_MEAN", "GQ_STDDEV", "HWP", "MQRankSum", "NCC", "MQ",
    "ReadPosRankSum", "QD", "VQSLOD",
]
INFO_KEPT_AS_TEXT = ["CIPOS", "CIEND", "FS"]
RUN_FIELDS = [
    "BaseQRankSum", "ClippingRankSum", "DP", "InbreedingCoeff", "MLEAC", "MLEAF", "MQ", "MQ0",
    "MQRankSum", "QD", "ReadPosRankSum", "SOR", "VQSLOD", "culprit",
]
INFINITE_FLOAT = 999.99
DEFAULT_QUAL = 100.0

# VEP sub-fields kept per transcript; all others belong to the variant.
VEP_TRANSCRIPT_FIELDS = [
    "Consequence", "IMPACT", "SYMBOL", "Gene", "Feature_type", "Feature", "BIOTYPE", "EXON", "INTRON",
    "HGVSc", "HGVSp", "cDNA_position", "CDS_position", "Protein_position", "Amino_acids", "Codons",
    "DISTANCE", "STRAND", "HGNC_ID", "SWISSPROT", "DOMAINS", "miRNA", "SIFT", "PolyPhen",
    "RadialSVM_score", "RadialSVM_pred", "LR_score", "LR_pred",
]
VEP_VARIANT_LISTS = ["CLIN_SIG", "MAX_AF_POPS"]
VEP_VARIANT_SKIPPED = ["AF", "SOMATIC"]

# Gene-context words of the ANNOVAR Func_* fields.
FUNC_IN_GENE = ["exonic", "intronic", "ncRNA_intronic"]
FUNC_WITH_DETAIL = ["UTR5", "UTR3", "splicing", "ncRNA_splicing"]
FUNC_BETWEEN = ["intergenic", "upstream\\x3bdownstream"]

# SnpEff sub-fields.
ANN_PAIRS = ["cDNA_pos/cDNA_length", "CDS_pos/CDS_length", "AA_pos/AA_length"]
ANN_INTEGERS = [
    "cDNA_pos", "cDNA_length", "CDS_pos", "CDS_length", "AA_pos", "AA_length", "Distance",
]
ANN_LISTS = ["ERRORS/WARNINGS/INFO"]
EFFECT_FLOATS = ["Percent_of_transcripts_affected"]
EFFECT_INTEGERS = ["Number_of_transcripts_in_gene"]

# Limits that shape results.
RESULT_ROWS = 400
FACET_VALUES = 30000
REGION_FLANK = 25

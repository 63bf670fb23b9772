"""Stored tables: one for variants and one long table per nested path."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixloom.functions import vocab as V
from helixloom.sources.vcf import Catalog

RECORDS_PER_FILE = 20_000_000
# Positions in one partition of a store that runs are published into, and that partition's column.
BUCKET_SIZE = 10_000_000
BUCKET = "POS_BUCKET"
# A Bloom filter on the key, as large as a row group's keys need; otherwise each is 1 MB, however few rows a file has.
# Candidates are halved from 1 MB: the smallest of twelve has 512 bytes.
KEY_FILTER = {"parquet.bloom.filter.enabled#variant_key": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.candidates.number#variant_key": "12"}

# What a load guarantees: one genotype per sample, and the document's place in every element row.
UNIQUE = {"sample": ["Sample_ID"]}
SHARED = ["CHROM", "POS"]


@dataclass
class Tables:
    """A warehouse in the long layout: ``base`` has one row per document, each path one per element.

    ``unique`` names, per path, the fields that tell a document's elements apart (such as the
    sample id); a search that shows them needs no de-duplication there. ``shared`` are columns that
    hold the same value in a document and in all its elements: filters on them reach every scan.
    """

    base: DataFrame
    paths: dict[str, DataFrame] = field(default_factory=dict)
    key: str = "variant_key"
    unique: dict[str, list[str]] = field(default_factory=dict)
    shared: list[str] = field(default_factory=list)


def bucket_of(size: int) -> Column:
    return F.floor(F.col("POS") / size)


def write_warehouse(df: DataFrame, path: str, mode: str = "overwrite", partitions: int | None = None, bucket: int | None = None) -> None:
    """Parquet by chromosome, sorted by position, so that region and point filters skip files.

    With ``bucket`` a chromosome is cut into partitions of so many positions, which ``replace_partitions`` can write one by one.

    The range shuffle splits a large chromosome over many tasks; without ``partitions`` the
    session's shuffle setting and adaptive coalescing decide. The key is a hash, which no sorting by
    position helps to find: Bloom filters on it let a lookup skip files.
    """
    order = [c for c in ("CHROM", "POS", "variant_key") if c in df.columns]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    by = ["CHROM"]
    if bucket:
        ranged, by = ranged.withColumn(BUCKET, bucket_of(bucket)), ["CHROM", BUCKET]
    (ranged.sortWithinPartitions(*order).write.mode(mode).option("maxRecordsPerFile", RECORDS_PER_FILE)
     .options(**KEY_FILTER).partitionBy(*by).parquet(path))


def replace_partitions(df: DataFrame, path: str, bucket: int) -> None:
    """Write the partitions that ``df`` has rows of; all other files stay as they are."""
    order = [c for c in ("CHROM", "POS", "variant_key") if c in df.columns]
    placed = df.repartitionByRange(*order).withColumn(BUCKET, bucket_of(bucket)).sortWithinPartitions(*order)
    (placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", RECORDS_PER_FILE)
     .options(**KEY_FILTER).partitionBy("CHROM", BUCKET).parquet(path))


def write_tables(tables: Tables, path: str, mode: str = "overwrite", partitions: int | None = None, bucket: int | None = None) -> None:
    """All tables of a warehouse. With ``bucket`` later runs can be published into it."""
    for name, rows in [("variants", tables.base), *tables.paths.items()]:
        write_warehouse(rows, f"{path}/{name}", mode, partitions, bucket)
        if bucket:
            write_schema(rows, path, name)


def write_schema(df: DataFrame, path: str, name: str) -> None:
    """A table's columns beside it: partitions written at different times need not have the same ones."""
    kept = T.StructType([f for f in df.schema.fields if f.name != BUCKET])
    df.sparkSession.createDataFrame([(kept.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_schemas/{name}")


def _folders(spark: SparkSession, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()) if fs.exists(folder) else []


def stored_paths(spark: SparkSession, path: str) -> list[str]:
    """The element tables that a stored warehouse has."""
    return [n for n in _folders(spark, path) if n != "variants" and not n.startswith(("_", "."))]


def read_stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One stored table, with its bucket column if it has one."""
    found = spark.read.parquet(f"{path}/{name}")
    kept = found.drop("CHROM", BUCKET).schema
    if name in _folders(spark, f"{path}/_schemas"):
        told = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/_schemas/{name}").first()[0]))
        kept = T.StructType([f for f in told.fields if f.name != "CHROM"])
    # CHROM is a directory name and would be guessed as a number: the schema says that it is text.
    kept = T.StructType([*kept.fields, T.StructField("CHROM", T.StringType()), *([T.StructField(BUCKET, T.LongType())] if BUCKET in found.columns else [])])
    return spark.read.schema(kept).parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, paths: Iterable[str] | None = None) -> Tables:
    """The stored tables; all element tables unless ``paths`` names some."""
    names = stored_paths(spark, path) if paths is None else paths
    return Tables(read_stored(spark, path, "variants").drop(BUCKET), {p: read_stored(spark, path, p).drop(BUCKET) for p in names}, unique=UNIQUE, shared=SHARED)


def save_bucketed(tables: Tables, database: str, buckets: int, mode: str = "overwrite") -> None:
    """The same tables bucketed by the document key in the session catalog: joins between
    documents and elements then need no shuffle."""
    for name, df in [("variants", tables.base), *tables.paths.items()]:
        (df.write.mode(mode).bucketBy(buckets, tables.key).sortBy(tables.key)
         .option("maxRecordsPerFile", RECORDS_PER_FILE).saveAsTable(f"{database}.{name}"))


def load_bucketed(spark: SparkSession, database: str, paths: Iterable[str], key: str = "variant_key") -> Tables:
    return Tables(spark.table(f"{database}.variants"), {p: spark.table(f"{database}.{p}") for p in paths}, key, UNIQUE)


def get_variant(df: DataFrame, key: str, column: str = "variant_key") -> DataFrame:
    """The document of one key, a filter that reaches the scan and its Bloom filters."""
    return df.filter(F.col(column) == key)


# --- schema ------------------------------------------------------------------------------

_SPARK_TYPES = {
    "keyword": T.StringType(), "string": T.StringType(), "text": T.StringType(), "character": T.StringType(),
    "integer": T.LongType(), "float": T.DoubleType(), "flag": T.StringType(), "boolean": T.BooleanType(),
}

# Nested members of the two annotation families and of a pedigree sample.
ANNOVAR_NESTED = {
    "AAChange_refGene": {"Gene": "keyword", "RefSeq": "keyword", "exon_id_rg": "keyword", "cdna_change_rg": "keyword", "aa_change_rg": "keyword"},
    "AAChange_ensGene": {"Ensembl_Gene_ID": "keyword", "Ensembl_Transcript_ID": "keyword", "exon_id_eg": "keyword", "cdna_change_eg": "keyword", "aa_change_eg": "keyword"},
    "CLNVAR_nested": {"CLNSIG": "keyword", "CLNDN": "keyword", "CLNREVSTAT": "keyword"},
    "GTEx_nested": {"GTEx_V6_gene": "keyword", "GTEx_V6_tissue": "text"},
    "ICGC_nested": {"ICGC_Cancer_Site": "keyword", "ICGC_Allele_Count": "integer", "ICGC_Allele_Number": "integer", "ICGC_Allele_Frequency": "float"},
    "COSMIC_nested": {"COSMIC_Occurrence": "integer", "COSMIC_Cancer_Site": "keyword"},
}
ANNOVAR_GENE_COLUMNS = {
    "Gene": "array", "Upstream": "keyword", "Downstream": "keyword", "GeneDetail": "array",
    "Distance_to_upstream": "integer", "Distance_to_downstream": "integer",
}
ANNOVAR_TRACKS = {
    "tfbsConsSites_Name": "keyword", "tfbsConsSites_Score": "integer", "targetScanS_Name": "keyword",
    "targetScanS_Score": "integer", "gwasCatalog": "array", "Interpro_domain": "text", "ICGC_ID": "keyword",
}
PEDIGREE_MEMBERS = [
    "Family_ID", "Father_ID", "Mother_ID", "Sex", "Age", "Phenotype", "Father_Phenotype", "Mother_Phenotype",
    "Father_Genotype", "Mother_Genotype", "Affected_Siblings_IDs", "Affected_Siblings_Sex", "Affected_Siblings_Ages",
    "Affected_Siblings_Genotypes", "Unaffected_Siblings_IDs", "Unaffected_Siblings_Sex", "Unaffected_Siblings_Ages",
    "Unaffected_Siblings_Genotypes",
]


def _struct(members: Mapping[str, str]) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, _SPARK_TYPES[t]) for n, t in members.items()]))


def warehouse_schema(catalog: Catalog, annot: str | None = None, case_control: bool = False, ped: bool = False,
                     csq_types: Mapping[str, str] | None = None) -> T.StructType:
    """The document type of one file: core fields, INFO fields, annotations and samples.

    Excluded fields are left out, cohort metrics are doubled for case/control data. Missing
    numbers are NULL, so no sentinel value is declared.
    """
    strings = T.ArrayType(T.StringType())
    fields: dict[str, T.DataType] = {
        "Variant": T.StringType(), "CHROM": T.StringType(), "POS": T.LongType(), "ID": T.StringType(),
        "REF": T.StringType(), "ALT": T.StringType(), "VariantType": T.StringType(), "dbSNP_ID": strings, "COSMIC_ID": strings,
    }
    metrics = {"QUAL": T.DoubleType(), "FILTER": strings}

    def add(name: str, kind: T.DataType, cohort: bool) -> None:
        if case_control and cohort:
            fields[name + "_case"], fields[name + "_control"] = kind, kind
        else:
            fields[name] = kind

    for name, kind in metrics.items():
        add(name, kind, True)
    replaced = {"CSQ", "ANN", "LOF", "NMD", "DP", "ICGC_Id", "ICGC_Occurrence", "VT"} if annot else {"CSQ", "VT"}
    for name, kind in catalog.info.items():
        if name in V.INFO_EXCLUDED or name in replaced or name in fields or name in ANNOVAR_NESTED:
            continue
        if name.startswith(("CLN", "GTEx_V6_", "GeneDetail_", "Gene_")) or "cosmic" in name:
            continue
        typed = T.StringType() if name in V.INFO_KEPT_AS_TEXT else _SPARK_TYPES.get(kind, T.StringType())
        add(name, typed, name in V.COHORT_FIELDS)
    if annot == "vep":
        types = dict(csq_types or {})
        members: list[T.StructField] = []
        for f in catalog.csq_fields:
            if f in ("SIFT", "PolyPhen"):
                members += [T.StructField(f + "_pred", T.StringType()), T.StructField(f + "_score", T.DoubleType())]
            elif f in V.VEP_TRANSCRIPT_FIELDS:
                kind = strings if f == "Consequence" else T.DoubleType() if f.endswith("score") else (
                    T.IntegerType() if types.get(f) == "integer" else T.StringType())
                members.append(T.StructField(f, kind))
            elif f not in V.VEP_VARIANT_SKIPPED and f != "Existing_variation":
                typed = {"float": T.ArrayType(T.DoubleType()), "integer": T.ArrayType(T.IntegerType())}.get(
                    types.get(f, ""), strings if f in V.VEP_VARIANT_LISTS else T.StringType())
                fields[f] = typed
        fields["CSQ_nested"] = T.ArrayType(T.StructType(members))
    elif annot == "annovar":
        for name, nested in ANNOVAR_NESTED.items():
            fields[name] = _struct(nested)
        for db in ("refGene", "ensGene"):
            for stem, kind in ANNOVAR_GENE_COLUMNS.items():
                fields[f"{stem}_{db}"] = strings if kind == "array" else T.IntegerType() if kind == "integer" else T.StringType()
        for name, kind in ANNOVAR_TRACKS.items():
            fields[name] = strings if kind == "array" else T.IntegerType() if kind == "integer" else T.StringType()
    sample = {"Sample_ID": T.StringType()}
    for name, kind in catalog.format.items():
        if name == "AD":
            sample["AD_ref"], sample["AD_alt"] = T.IntegerType(), T.IntegerType()
        else:
            sample[name] = T.IntegerType() if kind == "integer" else _SPARK_TYPES.get(kind, T.StringType())
    if case_control:
        sample["group"] = T.StringType()
    if ped:
        sample.update({m: T.StringType() for m in PEDIGREE_MEMBERS})
        sample["mendelian_diseases"] = strings
    fields["sample"] = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in sample.items()]))
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])

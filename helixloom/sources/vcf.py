"""VCF text to columns: header, lines, core fields, regions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.functions import vocab as V
from helixloom.functions.scalars import display_id, normalize_chrom, parse_float, parse_int, to_list, variant_class, variant_key
from helixloom.operators.sizing import spread

FIXED = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "format"]
KEYS = ["CHROM", "POS", "REF", "ALT"]


@dataclass
class Catalog:
    """What a header declares: field name -> type, sub-field lists, samples, contig lengths, and how many values a field has."""

    info: dict[str, str] = field(default_factory=dict)
    format: dict[str, str] = field(default_factory=dict)
    descriptions: dict[str, str] = field(default_factory=dict)
    subfields: dict[str, list[str]] = field(default_factory=dict)
    samples: list[str] = field(default_factory=list)
    contigs: dict[str, int] = field(default_factory=dict)
    info_numbers: dict[str, str] = field(default_factory=dict)
    format_numbers: dict[str, str] = field(default_factory=dict)

    @property
    def csq_fields(self) -> list[str]:
        return self.subfields.get("CSQ", [])


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Text lines of plain or gzip files.

    Gzip cannot be split, so its lines are dealt out after reading: over ``partitions`` if given,
    else over all cores when the files came as fewer pieces than that.
    """
    lines = spark.read.text(path)
    return lines.repartition(partitions) if partitions else spread(lines)


def header_lines(spark: SparkSession, file: str) -> list[str]:
    """The ``#`` lines at the top of one file. Reads no further than they go."""
    lines, n = spark.read.text(file), 1000
    while True:
        head = [r[0] for r in lines.take(n)]
        top = [x for x in head if x.startswith("#")]
        if len(top) < len(head) or len(head) < n:
            return top
        n *= 4


def read_headers(spark: SparkSession, path: str) -> tuple[list[str], dict[str, list[str]]]:
    """The declarations of all files, each once, and the sample names of every file.

    One file is read no further than its top. Several are read in one pass that keeps nothing but
    ``#`` lines, and gives every declaration once. A file without a heading is an error: its calls could not be named.
    """
    files = sorted(spark.read.text(path).inputFiles())
    if len(files) == 1:
        top = header_lines(spark, files[0])
        found = [(files[0] if x.startswith("#CHROM") else "", x) for x in top]
    else:
        v = F.col("value")
        rows = spark.read.text(path).filter(v.startswith("#")).select(
            F.when(v.startswith("#CHROM"), F.col("_metadata.file_path")).otherwise("").alias("file"), v).distinct()
        found = sorted(tuple(r) for r in rows.collect())
    headings = {f: x.rstrip("\r\n").split("\t")[9:] for f, x in found if f}
    # Spark writes one path as file:/x or file:///x.
    plain = lambda f: re.sub("^([a-zA-Z0-9]+):/+", r"\1:/", unquote(f))
    named = {plain(f) for f in headings}
    bare = [f for f in files if plain(f) not in named]
    if bare:
        raise ValueError(f"no #CHROM heading in {len(bare)} of {len(files)} files: {bare[:5]}")
    return [x for f, x in found if not f], headings


def all_samples(headings: dict[str, list[str]]) -> list[str]:
    """Sample names of all files, in the order of files and columns."""
    return list(dict.fromkeys(s for f in sorted(headings) for s in headings[f]))


def header_catalog(lines: DataFrame) -> DataFrame:
    """Declared fields as a table: section, name, type, description, subfields, length, number.

    Text types of frequencies and scores are declared wrongly by one annotator, so those names
    are taken as float. Dots become underscores.
    """
    v = F.col("value")
    name = F.regexp_extract(v, r"[<,]ID=([^,>]+)", 1)
    description = F.regexp_extract(v, r'Description="(.*?)"', 1)
    # Names whose declared type is overruled.
    as_float = name.rlike(r"^(gnomAD_|ExAC_|Eigen-|GERP\+\+|gerp\+\+)") | name.rlike(r"(score|SCORE|_frequency)$")
    declared = F.lower(F.regexp_extract(v, r"Type=([^,>]+)", 1))
    section = F.regexp_extract(v, r"^##(INFO|FORMAT|contig)=<", 1)
    kind = F.when((section == "INFO") & as_float, "float").when((section == "FORMAT") & (name == "PL"), "string").otherwise(declared)
    listed = F.regexp_extract(description, r"(?:Format: |')\s*([^']*\|[^']*)'?", 1)
    clean = F.transform(F.split(listed, r"\|"), lambda x: F.replace(F.replace(F.trim(x), F.lit("."), F.lit("_")), F.lit(" "), F.lit("")))
    return lines.filter(v.startswith("##")).filter(section != "").select(
        section.alias("section"), F.replace(name, F.lit("."), F.lit("_")).alias("name"), kind.alias("type"),
        description.alias("description"), F.when(listed != "", clean).alias("subfields"),
        F.regexp_extract(v, r"length=(\d+)", 1).try_cast("long").alias("length"),
        F.nullif(F.regexp_extract(v, r"Number=([^,>]+)", 1), F.lit("")).alias("number"))


def read_catalog(spark: SparkSession, path: str) -> Catalog:
    top, headings = read_headers(spark, path)
    out = collect_catalog(spark.createDataFrame([(x,) for x in top], "value string"))
    out.samples = all_samples(headings)
    return out


def collect_catalog(header: DataFrame) -> Catalog:
    """The catalog of header lines as plain names, small enough to write column lists from."""
    out = Catalog()
    for r in header_catalog(header).collect():
        if r["section"] == "contig":
            out.contigs[r["name"]] = r["length"]
            continue
        (out.info if r["section"] == "INFO" else out.format)[r["name"]] = r["type"]
        out.descriptions[r["name"]] = r["description"]
        if r["number"]:
            (out.info_numbers if r["section"] == "INFO" else out.format_numbers)[r["name"]] = r["number"]
        if r["subfields"]:
            out.subfields[r["name"]] = list(r["subfields"])
    heading = header.filter(F.col("value").startswith("#CHROM")).first()
    if heading:
        out.samples = heading["value"].rstrip("\r\n").split("\t")[9:]
    return out


def split_lines(lines: DataFrame, *carried: str) -> DataFrame:
    """Data lines as nine text columns and the array ``calls``; header lines are skipped."""
    parts = F.split(F.rtrim(F.col("value"), F.lit("\r\n")), "\t")
    rows = lines.filter(~F.col("value").startswith("#")).filter(F.col("value") != "").select("value", *carried, parts.alias("_p"))
    fixed = [F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(FIXED)]
    calls = F.slice("_p", 10, F.greatest(F.size("_p") - 9, F.lit(0)))
    return rows.select(*fixed, calls.alias("calls"), F.col("value").alias("_line"), *carried)


def read_vcf(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Split lines of one or many files, with ``calls`` in the order of ``all_samples`` whatever a file's own order is.

    A sample that a file does not have has a NULL call there. ``_ragged`` marks lines with another
    number of calls than their file's heading; their calls stay as they are.
    """
    _, headings = read_headers(spark, path)
    every = all_samples(headings)
    if all(names == every for names in headings.values()):
        rows = split_lines(read_lines(spark, path, partitions))
        return rows.withColumn("_ragged", (F.size("calls") != len(every)) & F.col("INFO").isNotNull())
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    lines = lines.repartition(partitions) if partitions else lines
    place = {f: {s: i for i, s in enumerate(names)} for f, names in headings.items()}
    layout = spark.createDataFrame([(f, len(names), [place[f].get(s, -1) for s in every]) for f, names in headings.items()],
                                   "_file string, _n int, _places array<int>")
    met = split_lines(lines, "_file").join(layout, "_file")
    ragged = (F.size("calls") != F.col("_n")) & F.col("INFO").isNotNull()
    placed = F.transform("_places", lambda p: F.when(p >= 0, F.get("calls", p)))
    return met.withColumn("_ragged", ragged).withColumn("calls", F.when(ragged, F.col("calls")).otherwise(placed)).drop("_file", "_n", "_places")


def line_errors(ragged: bool = False) -> Column:
    """Why a split line cannot be loaded, or NULL."""
    return (
        F.when(F.col("INFO").isNull(), "fewer than 8 columns")
        .when(F.col("_ragged") if ragged else F.lit(False), "number of calls differs from the heading")
        .when(parse_int("POS").isNull(), "POS is not a number")
        .when((F.col("QUAL") != ".") & parse_float("QUAL").isNull(), "QUAL is not a number")
        .when(F.coalesce(F.col("REF"), F.lit("")) == "", "REF is empty")
    )


def split_rejects(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loadable lines, and the others with their text and reason."""
    marked = raw.withColumn("_error", line_errors("_ragged" in raw.columns))
    good = marked.filter(F.col("_error").isNull()).drop("_error", "_line", "_ragged")
    bad = marked.filter(F.col("_error").isNotNull()).select(F.col("_line").alias("line"), F.col("_error").alias("reason"))
    return good, bad


def ingest_report(raw: DataFrame, known: DataFrame | None = None, key: str = "variant_key", plain_chrom: bool = True,
                  key_parts: tuple[str, ...] = (), catalog: Catalog | None = None) -> DataFrame:
    """Counters of one load in one row: processed, created, updated, failed, skipped.

    With the load's ``catalog`` also ``unreadable``: values of numeric fields in loadable lines that are no numbers.

    A line whose every sample is a no-call is skipped. ``known`` are the keys already stored; they are
    met with keys made as the load makes them, so ``plain_chrom`` and ``key_parts`` are those of the load.
    """
    from helixloom.operators.genotypes import is_no_call

    marked = raw.withColumn("_error", line_errors("_ragged" in raw.columns))
    called = F.exists("calls", lambda c: ~is_no_call(c))
    marked = marked.withColumn("_state", F.when(F.col("_error").isNotNull(), "failed").when(~called, "skipped").otherwise("loaded"))
    chrom = normalize_chrom("CHROM") if plain_chrom else F.col("CHROM")
    marked = marked.withColumn(key, variant_key(chrom, F.col("POS"), F.col("REF"), F.col("ALT"), F.col("ID"), *[F.lit(k) for k in key_parts]))
    if known is not None:
        stored = known.select(key).distinct().withColumn("_stored", F.lit(True))
        marked = marked.join(stored, key, "left")
    else:
        marked = marked.withColumn("_stored", F.lit(None).cast("boolean"))
    loaded = F.col("_state") == "loaded"
    report = marked.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(loaded & F.col("_stored").isNull()).alias("created"),
        F.count_if(loaded & F.col("_stored").isNotNull()).alias("updated"),
        F.count_if(F.col("_state") == "failed").alias("failed"),
        F.count_if(F.col("_state") == "skipped").alias("skipped"),
    )
    if catalog is None:
        return report
    from helixloom.operators.alleles import unreadable_values

    bad = unreadable_values(raw.filter(line_errors("_ragged" in raw.columns).isNull()), catalog.info, catalog.info_numbers)
    return report.withColumn("unreadable", bad.agg(F.coalesce(F.sum("unreadable"), F.lit(0))).scalar())


def normalize_variants(raw: DataFrame, rule: str = "base", sep: str = "_", key_parts: tuple[str, ...] = ()) -> DataFrame:
    """Typed core fields, display id, document key, id list and variant class."""
    identified = F.when(F.col("ID") != ".", F.col("ID"))
    typed = raw.select(
        variant_key(F.col("CHROM"), F.col("POS"), F.col("REF"), F.col("ALT"), F.col("ID"), *[F.lit(k) for k in key_parts]).alias("variant_key"),
        display_id("CHROM", "POS", "REF", "ALT", sep).alias("Variant"),
        "CHROM", parse_int("POS").alias("POS"), identified.alias("ID"), "REF", "ALT",
        F.when(F.col("QUAL") == ".", F.lit(V.DEFAULT_QUAL)).otherwise(parse_float("QUAL")).alias("QUAL"),
        to_list("FILTER", ";").alias("FILTER"),
        F.when(identified.startswith("rs"), F.split(identified, ";")).alias("dbSNP_ID"),
        variant_class("REF", "ALT", rule).alias("VariantType"),
        *[F.col(c) for c in raw.columns if c not in FIXED[:7]],
    )
    return typed


def region(df: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Both bounds included. Prunes the chromosome partition and row groups of a written warehouse."""
    return df.filter((F.col("CHROM") == chrom) & F.col("POS").between(start, end))

"""From VCF text and a pedigree to warehouse tables, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixloom.functions import vocab as V
from helixloom.functions.scalars import normalize_chrom
from helixloom.operators.alleles import split_alleles, with_vectors
from helixloom.operators.annotations import annotate
from helixloom.operators.genotypes import unpivot_genotypes, unpivot_with_pedigree
from helixloom.operators.inheritance import lof_condition, tag_modes
from helixloom.operators.merging import concat_cohorts, label_metrics, merge_case_control, upsert_rows, upsert_variants
from helixloom.operators.info import csq_types, parse_info, profile_fields, refine_catalog, with_info
from helixloom.operators.sizing import broadcast_if, is_small, written
from helixloom.sources.vcf import Catalog, normalize_variants, read_catalog, read_vcf, split_rejects
from helixloom.sources.warehouse import (BUCKET, BUCKET_SIZE, SHARED, UNIQUE, Tables, bucket_of, read_stored, read_tables, replace_partitions, stored_paths,
                                         write_schema, write_tables)

KEYS = ["variant_key", "CHROM", "POS"]
# What makes a variant, in whichever file it stands.
VARIANT = ["CHROM", "POS", "REF", "ALT"]
# Spark names ignore case, so the flag must not be called like the annotation field LOF.
LOF = "loss_of_function"


def lof_genes(variants: DataFrame) -> Column:
    """Genes in which a variant is loss-of-function, as an array column.

    VEP: gene and consequence must be on the same transcript. ANNOVAR: the variant as a whole is
    loss-of-function, its genes come from its transcript changes.
    """
    if "CSQ_nested" in variants.columns:
        hit = F.filter("CSQ_nested", lambda e: lof_condition(e["Consequence"]))
        return F.array_distinct(F.array_compact(F.transform(hit, lambda e: e["SYMBOL"])))
    if "AAChange_refGene" in variants.columns:
        flags = [c for c in variants.columns if c.startswith(("ExonicFunc_", "Func_"))]
        genes = F.array_distinct(F.array_compact(F.transform("AAChange_refGene", lambda e: e["Gene"])))
        return F.when(lof_condition(columns=flags), genes)
    return F.lit(None).cast("array<string>")


def with_lof(variants: DataFrame) -> DataFrame:
    """The variant-level loss-of-function flag of either annotation."""
    if "CSQ_nested" in variants.columns:
        terms = F.flatten(F.transform("CSQ_nested", lambda e: F.coalesce(e["Consequence"], F.array().cast("array<string>"))))
        return variants.withColumn(LOF, lof_condition(terms))
    flags = [c for c in variants.columns if c.startswith(("ExonicFunc_", "Func_"))]
    return variants.withColumn(LOF, lof_condition(columns=flags) if flags else F.lit(False))


def parse_variants(raw: DataFrame, catalog: Catalog, types: dict[str, str] | None = None) -> DataFrame:
    """Typed core, INFO and annotation columns of split lines, with ``format`` and ``calls`` kept."""
    core = with_info(normalize_variants(raw))
    plain = with_vectors(parse_info(core, catalog.info), catalog.info, catalog.info_numbers)
    full = annotate(plain, catalog.info, catalog.csq_fields, types, catalog.subfields)
    return full.drop("_keys", "_values", "INFO")


def long_tables(variants: DataFrame, genotypes: DataFrame | None = None) -> Tables:
    """Nested annotation arrays as element tables, everything else as the variant table."""
    nested = [f.name for f in variants.schema.fields
              if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    base = variants.drop(*nested, "format", "calls")
    paths = {}
    for p in nested:
        members = [f"_e.{m}" for m in variants.schema[p].dataType.elementType.fieldNames()]
        e = variants.select(*KEYS, F.explode(p).alias("_e"))
        paths[p] = e.select(*KEYS, *[F.col("_e")[m[3:]].alias(m[3:]) for m in members])
    if genotypes is not None:
        paths["sample"] = genotypes
    return Tables(base, paths, unique=UNIQUE, shared=SHARED)


def load_vcf(spark: SparkSession, path: str, ped: DataFrame | None = None, assembly: str = "hg19",
             partitions: int | None = None, profile: bool = True, stage: bool = True, plain_chrom: bool = True,
             split: bool = False) -> tuple[Tables, DataFrame]:
    """Warehouse tables of a VCF and its rejected lines.

    With a pedigree all calls are kept, enriched and tagged; without one reference calls are
    dropped. ``profile`` corrects the declared types by a pass over all lines. The parsed lines
    are written once to the shared folder (``stage``), since every table is made from them.
    ``plain_chrom`` turns ``chrX`` into ``X``, as the rules for X and Y need. A file without a heading is an error; a
    line whose number of calls differs from its file's heading is rejected.

    A line of several alternate alleles is one document whose aligned fields are whole in ``<field>_by_allele``;
    with ``split`` it is one document per allele.
    """
    catalog = read_catalog(spark, path)
    good, bad = split_rejects(read_vcf(spark, path, partitions))
    if split:
        good = split_alleles(good, catalog).drop("_allele")
    if plain_chrom:
        good = good.withColumn("CHROM", normalize_chrom("CHROM"))
    types = csq_types(catalog)
    if profile:
        found = profile_fields(good, catalog.csq_fields).collect()  # one row per field
        catalog, types = refine_catalog(catalog, found), csq_types(catalog, found)
    variants = with_lof(parse_variants(good, catalog, types))
    if stage:
        variants = written(variants, "variants")
    if ped is None:
        samples = unpivot_genotypes(variants, catalog.samples, KEYS, catalog.format, keep_homref=False)
    else:
        carried = [*KEYS, LOF, "_genes"]
        calls = unpivot_with_pedigree(variants.withColumn("_genes", lof_genes(variants)), catalog.samples, carried, ped, catalog.format, siblings=True)
        samples = tag_modes(calls, "_genes", assembly, lof=LOF).drop("_genes")
    return long_tables(variants, samples), bad


def _together(parts: list[DataFrame]) -> DataFrame:
    """Union by name; a column that one part has as a whole and another as a decimal number or text takes the wider type."""
    ranks = {"tinyint": 0, "smallint": 0, "int": 1, "bigint": 2, "float": 3, "double": 3, "string": 4}
    kinds: dict[str, str] = {}
    for df in parts:
        for name, kind in df.dtypes:
            if name not in kinds or ranks.get(kind, -1) > ranks.get(kinds[name], 9):
                kinds[name] = kind
    cast = [df.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if k in ranks else F.col(f"`{c}`") for c, k in df.dtypes]) for df in parts]
    out = cast[0]
    for df in cast[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def one_key(parts: list[Tables]) -> list[Tables]:
    """The same ``variant_key`` for a variant in all parts, whatever its ID column said.

    A variant is its chromosome, position, reference and alternate allele. The first part that has it names the key, the smallest
    of several. Only narrow keys are shuffled; where no key differs, the tables come back as they are.
    """
    ranked = [t.base.select(*VARIANT, "variant_key", F.lit(i).alias("_rank")) for i, t in enumerate(parts)]
    every = ranked[0]
    for r in ranked[1:]:
        every = every.unionByName(r)
    chosen = every.groupBy(*VARIANT).agg(F.min(F.struct("_rank", "variant_key"))["variant_key"].alias("_to"), F.count_distinct("variant_key").alias("_n"))
    moved = every.join(chosen.filter("_n > 1"), VARIANT).filter("variant_key <> _to").select(*KEYS, "_to").distinct()
    moved = written(moved, "moved-keys")
    if moved.isEmpty():
        return parts
    moved = broadcast_if(is_small(moved), moved)

    def renamed(df: DataFrame) -> DataFrame:
        return df.join(moved, KEYS, "left").withColumn("variant_key", F.coalesce("_to", "variant_key")).select(*df.columns)

    return [Tables(renamed(t.base), {p: renamed(rows) for p, rows in t.paths.items()}, t.key, t.unique, t.shared) for t in parts]


def load_case_control(spark: SparkSession, case: str, control: str, ped: DataFrame | None = None, **options) -> tuple[Tables, DataFrame]:
    """Warehouse tables of two VCFs: one document per variant of either, and the rejects of both.

    Variants meet by chromosome, position and alleles, whatever their IDs. Cohort metrics, QUAL and FILTER
    carry ``_case`` or ``_control``; other fields take the control's value where it has one. Genotypes of both cohorts stay long and carry their ``group``;
    annotations of a variant that both have are kept once. ``options`` are those of ``load_vcf``.
    """
    sides = {group: load_vcf(spark, path, ped, **options) for group, path in (("case", case), ("control", control))}
    (a, bad_a), (b, bad_b) = sides["case"], sides["control"]
    b, a = one_key([b, a])
    base = merge_case_control(a.base, b.base, ["variant_key", "CHROM", "POS", "REF", "ALT"])
    paths = {}
    for p in dict.fromkeys([*a.paths, *b.paths]):
        if p == "sample":
            paths[p] = concat_cohorts(a.paths[p], b.paths[p]).dropDuplicates(["variant_key", "Sample_ID", "group"])
        else:
            paths[p] = _together([t.paths[p] for t in (a, b) if p in t.paths]).dropDuplicates()
    rejects = bad_a.withColumn("group", F.lit("case")).unionByName(bad_b.withColumn("group", F.lit("control")))
    return Tables(base, paths, unique={"sample": ["Sample_ID", "group"]}, shared=SHARED), rejects


def labelled_run(tables: Tables, label: str | None, run_fields: list[str] | None = None) -> Tables:
    """The tables of one run with its metrics under its label."""
    return Tables(label_metrics(tables.base, label, run_fields=_run_fields(tables.base, run_fields)), tables.paths, tables.key, tables.unique, tables.shared)


def _run_fields(base: DataFrame, run_fields: list[str] | None) -> list[str]:
    known = ["FILTER", "QUAL", *(V.RUN_FIELDS if run_fields is None else run_fields)]
    return [f for f in dict.fromkeys(known) if f in base.columns]


def _with_run(old: Tables, run: Tables, label: str | None, run_fields: list[str] | None) -> Tables:
    """Stored tables and a run's together: tables and columns of both, documents matched by variant."""
    # The stored key stays; the run's rows take it.
    run = one_key([Tables(old.base, {}), run])[1]
    new = labelled_run(run, label, run_fields)
    counts = [f"{c}_{label}" for c in ("AC", "AF", "AN") if label]
    base = upsert_variants(old.base, new.base, append=(), labelled=_run_fields(run.base, run_fields), fresh=counts)
    paths = {}
    for p in dict.fromkeys([*old.paths, *new.paths]):
        if p not in new.paths or p not in old.paths:
            paths[p] = (old.paths if p in old.paths else new.paths)[p]
        elif p == "sample":
            known, rows = old.paths[p], new.paths[p]
            paths[p] = upsert_rows(_widened(known, rows), _widened(rows, known), ["variant_key", "Sample_ID"])
        else:
            paths[p] = _together([old.paths[p], new.paths[p]]).dropDuplicates()
    return Tables(base, paths, old.key, old.unique, old.shared)


def _widened(df: DataFrame, other: DataFrame) -> DataFrame:
    """With the columns that only the other has, as NULL."""
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema.fields if f.name not in df.columns])


def add_run(spark: SparkSession, stored: str, published: str, run: Tables, label: str | None, run_fields: list[str] | None = None) -> Tables:
    """Add a labelled run to a stored warehouse and write the result beside it as a new version.

    Stored documents gain the run's labelled entries and counts, unknown ones are added whole. A
    genotype of a sample that the run has again replaces the stored one. Element rows are added once; tables and columns that
    only one side has are kept. The stored version stays as it is until the caller drops it, so readers and retries see whole
    versions. This writes the whole warehouse; ``publish_run`` writes only what the run touches.
    """
    if stored.rstrip("/") == published.rstrip("/"):
        raise ValueError("a new version needs a folder of its own")
    tables = _with_run(read_tables(spark, stored), run, label, run_fields)
    write_tables(tables, published)
    return read_tables(spark, published, list(tables.paths))


# Types that Parquet files of the first can be read as.
_READABLE = {("int", "bigint"), ("int", "double"), ("smallint", "int"), ("smallint", "bigint"), ("float", "double")}


def publish_run(spark: SparkSession, folder: str, run: Tables, label: str | None, run_fields: list[str] | None = None, bucket: int = BUCKET_SIZE) -> Tables:
    """Add a labelled run to a stored warehouse in place, rewriting only the partitions it has variants in.

    The warehouse was written with the same ``bucket``. Rows of the touched partitions are merged as ``add_run`` does, stored in the
    shared folder, and then take the place of these partitions; files of all others stay. A run
    whose new partitions are half published can be published again: the merge gives the same rows. Columns that are
    new come as NULL from older files. A column whose type older files cannot be read as is an error before anything is written.
    """
    names = stored_paths(spark, folder)
    whole = {n: read_stored(spark, folder, n) for n in ["variants", *names]}
    if BUCKET not in whole["variants"].columns:
        raise ValueError("the warehouse was written without buckets; add_run writes a new version of it")
    # As many rows as there are partitions.
    touched: dict[str, list[int]] = {}
    for r in run.base.select("CHROM", bucket_of(bucket).alias("b")).distinct().collect():
        touched.setdefault(r["CHROM"], []).append(r["b"])
    if not touched:
        return read_tables(spark, folder)
    within = F.lit(False)
    for chrom, buckets in sorted(touched.items()):
        within = within | ((F.col("CHROM") == chrom) & F.col(BUCKET).isin(sorted(buckets)))
    part = {n: df.filter(within).drop(BUCKET) for n, df in whole.items()}
    merged = _with_run(Tables(part["variants"], {n: part[n] for n in names}), run, label, run_fields)
    tables = {"variants": merged.base} | {p: rows for p, rows in merged.paths.items() if p in run.paths}
    for name, rows in tables.items():
        if name in whole:
            kinds = dict(rows.dtypes)
            changed = [(c, k, kinds[c]) for c, k in part[name].dtypes if kinds[c] != k and (k, kinds[c]) not in _READABLE]
            if changed:
                raise ValueError(f"{name}: stored files cannot be read with other types {changed}; add_run writes a new version")
    ready = {name: written(rows, "touched") for name, rows in tables.items()}
    for name, rows in ready.items():
        replace_partitions(rows, f"{folder}/{name}", bucket)
        write_schema(rows, folder, name)
    return read_tables(spark, folder)

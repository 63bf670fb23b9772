"""Cohorts put together: labels, case/control, upsert, load audit, catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixloom.functions import vocab as V

KEYS = ["CHROM", "POS", "REF", "ALT"]


def label_metrics(df: DataFrame, label: str | None, counts: Sequence[str] = ("AC", "AF", "AN"),
                  run_fields: Sequence[str] | None = None) -> DataFrame:
    """AC/AF/AN renamed with the label; run-dependent fields as ``[{FIELD_label, FIELD_value}]``.

    A missing value gives no entry. Without a label the entries hold only the value.
    """
    run = ["FILTER", "QUAL", *V.RUN_FIELDS] if run_fields is None else list(run_fields)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in counts and label:
            out.append(c.alias(f"{f.name}_{label}"))
        elif f.name in run:
            members = [F.lit(label).alias(f"{f.name}_label")] if label else []
            value = c
            present = c.isNotNull()
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                present = present & ~F.isnan(c)
            entry = F.array(F.struct(*members, value.alias(f"{f.name}_value")))
            out.append(F.when(present, entry).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def suffix_cohort(df: DataFrame, group: str, fields: Sequence[str] | None = None) -> DataFrame:
    """Cohort metrics (and QUAL, FILTER) renamed with ``_case`` or ``_control``."""
    names = set(V.COHORT_FIELDS + ["QUAL", "FILTER"] if fields is None else fields)
    return df.select(*[F.col(f"`{c}`").alias(f"{c}_{group}" if c in names else c) for c in df.columns])


def concat_arrays(a: Column, b: Column) -> Column:
    """Joined arrays where a missing side adds nothing; NULL only when both are missing."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, b))


def unique_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key. Of repeated lines the one with the highest QUAL stays, then the one whose content is last in
    text order, whatever the order of reading. Rows meet by the key and keep that partitioning for a join on it."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rank = F.struct(*[F.col(c) for c in ("QUAL",) if c in df.columns], F.to_json(row).alias("text"))
    return df.select(*keys, row.alias("_row"), rank.alias("_rank")).groupBy(*keys).agg(F.max_by("_row", "_rank").alias("_row")).select("_row.*")


def merge_case_control(case: DataFrame, control: DataFrame, keys: Sequence[str] = KEYS,
                       arrays: Sequence[str] = (), fields: Sequence[str] | None = None) -> DataFrame:
    """One row per variant of either cohort, matched on the full key.

    Cohort metrics come from their side under a suffix, ``arrays`` are joined case first, every
    other shared field takes the control's value where it has one. The genotypes themselves are
    better kept long (``concat_cohorts``); then nothing but narrow rows is shuffled here. Lines that
    repeat a key count once on each side (``unique_rows``).
    """
    a, b = (suffix_cohort(unique_rows(df, keys), group, fields) for df, group in ((case, "case"), (control, "control")))
    left = a.select(*keys, F.struct(*[F.col(f"`{c}`") for c in a.columns]).alias("_a"))
    right = b.select(*keys, F.struct(*[F.col(f"`{c}`") for c in b.columns]).alias("_b"))
    both = left.join(right, list(keys), "full_outer")
    out = []
    for c in dict.fromkeys([*a.columns, *b.columns]):
        if c in keys:
            continue
        sides = ([F.col("_b")[c]] if c in b.columns else []) + ([F.col("_a")[c]] if c in a.columns else [])
        value = concat_arrays(sides[1], sides[0]) if c in arrays and len(sides) == 2 else F.coalesce(*sides)
        out.append(value.alias(c))
    return both.select(*keys, *out)


def concat_cohorts(case: DataFrame, control: DataFrame) -> DataFrame:
    """Genotype rows of both cohorts with their group: a union, no shuffle."""
    return case.withColumn("group", F.lit("case")).unionByName(
        control.withColumn("group", F.lit("control")), allowMissingColumns=True)


def _without_labels(target: DataFrame, name: str, stored: Column, new: Column) -> Column:
    """Stored entries but those of a label that the new ones have."""
    kind, label = target.schema[name].dataType, f"{name}_label"
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and label in kind.elementType.fieldNames()):
        return stored
    told = F.transform(F.coalesce(new, F.filter(stored, lambda _: F.lit(False))), lambda e: e[label])
    return F.filter(stored, lambda e: ~F.coalesce(F.array_contains(told, e[label]), F.lit(False)))


def upsert_variants(target: DataFrame, batch: DataFrame, key: str = "variant_key",
                    append: Sequence[str] = ("sample",), labelled: Sequence[str] = (), fresh: Sequence[str] = ()) -> DataFrame:
    """New version of the target: stored documents gain the batch's samples and labelled entries,
    unknown ones are added whole. ``fresh`` fields (the label's own counts) are taken from the
    batch; all other fields of a stored document stay. A key that the batch repeats counts once. Entries of a label
    that the batch has for a document take the place of stored ones, so a batch may come again."""
    batch = unique_rows(batch, [key])
    lists = [*append, *labelled]
    left = target.select(key, F.struct(*[F.col(f"`{c}`") for c in target.columns]).alias("_t"))
    right = batch.select(key, F.struct(*[F.col(f"`{c}`") for c in batch.columns]).alias("_n"))
    both = left.join(right, key, "full_outer")
    out = []
    for c in dict.fromkeys([*target.columns, *batch.columns]):
        if c == key:
            continue
        stored = F.col("_t")[c] if c in target.columns else None
        new = F.col("_n")[c] if c in batch.columns else None
        if stored is None:
            value = new if c in fresh or c in lists else F.when(F.col("_t").isNull(), new)
        elif new is None:
            value = stored
        elif c in lists:
            value = concat_arrays(_without_labels(target, c, stored, new) if c in labelled else stored, new)
        elif c in fresh:
            value = F.coalesce(new, stored)
        else:
            value = F.when(F.col("_t").isNull(), new).otherwise(stored)
        out.append(value.alias(c))
    return both.select(key, *out)


def upsert_rows(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long layout of the same upsert: a batch row replaces the stored row of its key.

    A batch sent again therefore changes nothing, which a retried load needs.
    """
    kept = target.join(batch.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


def audit_load(loaded_file: DataFrame, warehouse: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every variant of a file with its number of lines there and whether the warehouse has it.

    ``missing`` are rows with ``found = false``, duplicates those with ``lines > 1``.
    """
    lines = loaded_file.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"))
    stored = warehouse.select(*keys).distinct().withColumn("_s", F.lit(True))
    return lines.join(stored, list(keys), "left").select(*keys, "lines", F.coalesce("_s", F.lit(False)).alias("found"))


def missing_variants(loaded_file: DataFrame, warehouse: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return loaded_file.select(*keys).distinct().join(warehouse.select(*keys).distinct(), list(keys), "left_anti")


# --- catalogs ----------------------------------------------------------------------------

def merge_catalogs(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("section", "name")) -> DataFrame:
    """Fields of two headers; the second wins."""
    left = a.select(*keys, F.struct(*[c for c in a.columns if c not in keys]).alias("_a"))
    right = b.select(*keys, F.struct(*[c for c in b.columns if c not in keys]).alias("_b"))
    both = left.join(right, list(keys), "full_outer")
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    return both.select(*keys, *[F.when(F.col("_b").isNotNull(), F.col("_b")[c]).otherwise(F.col("_a")[c]).alias(c) for c in shared])


def catalog_diff(a: DataFrame, b: DataFrame, key: Sequence[str] = ("section", "name")) -> DataFrame:
    """Fields of the first catalog that the second does not know."""
    return a.join(b.select(*key).distinct(), list(key), "left_anti")


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()

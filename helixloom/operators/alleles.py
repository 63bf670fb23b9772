"""Fields that are aligned with alleles, and lines of several alternate alleles.

A header's ``Number`` says what a list holds: ``A`` one value per alternate allele, ``R`` one per allele with the
reference first, ``G`` one per genotype. Genotype (j, k), j <= k, of a diploid call stands at ``k (k + 1) / 2 + j``;
a haploid call has one value per allele.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.functions import vocab as V
from helixloom.functions.scalars import clean_number, parse_float, parse_int
from helixloom.operators.info import cut_info, drop_cut, info_text, with_info
from helixloom.sources.vcf import Catalog

ALIGNED = ("A", "R", "G")


def vector_name(field: str) -> str:
    return f"{field}_by_allele"


def vector_types(types: Mapping[str, str], numbers: Mapping[str, str]) -> dict[str, str]:
    """Numeric fields with a value per allele or genotype."""
    return {n: k for n, k in types.items() if k in ("integer", "float") and numbers.get(n) in ALIGNED and n not in V.INFO_EXCLUDED and n not in V.INFO_KEPT_AS_TEXT}


def with_vectors(df: DataFrame, types: Mapping[str, str], numbers: Mapping[str, str]) -> DataFrame:
    """Add ``<field>_by_allele`` for each aligned numeric field: all values in the order of the line, ``.`` and unreadable ones NULL.

    The plain column of such a field holds the value of lines with one; lists are whole here.
    """
    wanted = vector_types(types, numbers)
    if not wanted:
        return df
    df = cut_info(df if "_keys" in df.columns else with_info(df), list(wanted))
    parse = {"integer": parse_int, "float": lambda x: clean_number(parse_float(x))}
    return drop_cut(df.withColumns({vector_name(n): F.transform(F.split(info_text(n), ","), parse[k]) for n, k in wanted.items()}))


def unreadable_values(df: DataFrame, types: Mapping[str, str], numbers: Mapping[str, str] | None = None) -> DataFrame:
    """(name, values, unreadable) of the numeric INFO fields: how many values a load cannot turn into numbers.

    A list counts each of its values where the field is aligned with alleles, else a list is unreadable
    as a whole, like text. Counted in one pass, one row of counters per task.
    """
    numeric = {n: k for n, k in types.items() if k in ("integer", "float") and n not in V.INFO_EXCLUDED and n not in V.INFO_KEPT_AS_TEXT}
    aligned = vector_types(numeric, numbers or {})
    df = cut_info(df if "_keys" in df.columns else with_info(df), list(numeric))
    counters = []
    for name, kind in numeric.items():
        parse = parse_int if kind == "integer" else parse_float
        given = F.filter(F.split(info_text(name), ",") if name in aligned else F.array_compact(F.array(info_text(name))), lambda x: ~x.isin(".", ""))
        bad = F.filter(given, lambda x: parse(x).isNull())  # noqa: B023 - called at once
        counters += [F.sum(F.greatest(F.size(given), F.lit(0))), F.sum(F.greatest(F.size(bad), F.lit(0)))]
    if not counters:
        return df.sparkSession.createDataFrame([], "name string, values long, unreadable long")
    one = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(counters)])
    rows = [F.struct(F.lit(n).alias("name"), F.coalesce(F.col(f"c{2 * i}"), F.lit(0)).alias("values"), F.coalesce(F.col(f"c{2 * i + 1}"), F.lit(0)).alias("unreadable"))
            for i, n in enumerate(numeric)]
    return one.select(F.inline(F.array(*rows)))


# --- one line per alternate allele -----------------------------------------------------------

def genotype_place(j: Column, k: Column) -> Column:
    """Place of the diploid genotype (j, k), j <= k, among the values of a G field, from zero."""
    return (k * (k + 1) / 2 + j).cast("int")


def _picked(values: Column, places: list[Column]) -> Column:
    return F.array_join(F.array(*[F.coalesce(F.get(values, p), F.lit(".")) for p in places]), ",")


def _aligned(value: Column, number: Column, allele: Column, alleles: Column) -> Column:
    """A list cut down to the reference and one alternate allele. A list of another length than its Number asks for stays as it is."""
    values = F.split(value, ",")
    zero, n = F.lit(0), F.size(values)
    diploid = [zero, genotype_place(zero, allele), genotype_place(allele, allele)]
    return (F.when((number == "A") & (n == alleles - 1), _picked(values, [allele - 1]))
            .when((number == "R") & (n == alleles), _picked(values, [zero, allele]))
            .when((number == "G") & (n == alleles), _picked(values, [zero, allele]))
            .when((number == "G") & (n == genotype_place(alleles - 1, alleles - 1) + 1), _picked(values, diploid))
            .otherwise(value))


def _genotype(gt: Column, allele: Column) -> Column:
    """The allele as 1, the reference and other alleles as 0, missing ones as they are; unphased ones in order."""
    phased = gt.contains("|")
    told = F.transform(F.split(gt, r"[/|]"), lambda x: F.when(x == ".", x).when(x == allele.cast("string"), "1").otherwise("0"))
    return F.when(phased, F.array_join(told, "|")).otherwise(F.array_join(F.array_sort(told), "/"))


def _number_of(name: Column, numbers: Mapping[str, str]) -> Column:
    by = {k: [n for n, v in numbers.items() if v == k] for k in ALIGNED}
    out = F.when(F.lit(False), F.lit(""))
    for k, names in by.items():
        if names:
            out = out.when(name.isin(names), k)
    return out


def split_alleles(raw: DataFrame, catalog: Catalog) -> DataFrame:
    """One line per alternate allele: a line ``A>C,G`` becomes ``A>C`` and ``A>G``; lines of one allele stay untouched.

    INFO and FORMAT fields with Number A, R or G keep the values of their allele, GT counts the allele as 1 and the
    others as 0; all else is copied. Lines stay text, so whatever reads lines reads these. ``_allele`` is the
    allele's place in the line. No shuffle.
    """
    alts = F.split("ALT", ",")
    rows = raw.select(*[F.col(f"`{c}`") for c in raw.columns], F.size(alts).alias("_alts"), F.posexplode(alts).alias("_at", "_alt"))
    rows = rows.withColumn("_allele", F.col("_at") + 1)
    allele, alleles = F.col("_allele"), F.col("_alts") + 1

    def info_entry(e: Column) -> Column:
        name = F.substring_index(e, "=", 1)
        value = F.substr(e, F.locate("=", e) + 1)
        number = _number_of(F.replace(name, F.lit("."), F.lit("_")), catalog.info_numbers)
        return F.when(e.contains("=") & number.isNotNull(), F.concat(name, F.lit("="), _aligned(value, number, allele, alleles))).otherwise(e)

    def call(c: Column) -> Column:
        parts = F.arrays_zip(F.split("format", ":").alias("k"), F.split(c, ":").alias("v"))
        told = F.transform(F.filter(parts, lambda p: p["v"].isNotNull()), lambda p: F.when(p["k"] == "GT", _genotype(p["v"], allele)).otherwise(
            _aligned(p["v"], _number_of(p["k"], catalog.format_numbers), allele, alleles)))
        return F.array_join(told, ":")

    several = F.col("_alts") > 1
    changed = {"ALT": F.col("_alt"), "INFO": F.when(several, F.array_join(F.transform(F.split("INFO", ";"), info_entry), ";")).otherwise(F.col("INFO"))}
    if "calls" in raw.columns:
        changed["calls"] = F.when(several, F.transform("calls", call)).otherwise(F.col("calls"))
    out = rows.withColumns(changed)
    return out.select(*[F.col(f"`{c}`") for c in raw.columns], "_allele")

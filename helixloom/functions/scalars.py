"""Column functions: text and number clean-up, type tests, keys and display strings."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixloom.functions import vocab as V

INT_PATTERN = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
FLOAT_PATTERN = (
    r"(?i)^\s*[+-]?(([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+)?"
    r"|nan|inf|infinity)\s*$"
)


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- numbers -----------------------------------------------------------------------------

def is_int(c: Column | str) -> Column:
    """True for whole-number text such as ``5`` or `` 5 ``, not for ``5.0`` or ``1e5``."""
    c = column(c)
    return c.try_cast("bigint").isNotNull() | c.rlike(INT_PATTERN)


def is_float(c: Column | str) -> Column:
    """True for decimal text that is not a whole number (``1.0``, ``1e5``, ``nan``)."""
    c = column(c)
    return c.rlike(FLOAT_PATTERN) & ~c.rlike(INT_PATTERN)


def infer_type(c: Column | str) -> Column:
    """``float``, ``integer`` or ``keyword`` for one text value."""
    return F.when(is_int(c), "integer").when(parse_float(c).isNotNull(), "float").otherwise("keyword")


def parse_int(c: Column | str) -> Column:
    """Whole number or NULL. Only digits grouped by ``_`` need more than the cast."""
    c = column(c)
    grouped = F.when(c.rlike(INT_PATTERN), F.regexp_replace(c, "[_\\s]", "").try_cast("bigint"))
    return F.coalesce(c.try_cast("bigint"), F.when(c.contains("_"), grouped))


def parse_float(c: Column | str) -> Column:
    """Decimal number or NULL. The cast alone also reads Java forms such as ``1f`` or ``0x1p3``, so
    text with such letters (and grouped digits) must match the pattern first."""
    c = column(c)
    plain = F.translate(c, "fFdDxXpP_", "") == c
    guarded = F.when(c.rlike(FLOAT_PATTERN), F.regexp_replace(c, "[_\\s]", "").try_cast("double"))
    return F.when(plain, c.try_cast("double")).otherwise(guarded)


def clean_number(c: Column | str, nan: float | None = None, inf: float = V.INFINITE_FLOAT) -> Column:
    """Replace NaN (NULL by default) and both infinities of a double column."""
    c = column(c)
    return (
        F.when(F.isnan(c), F.lit(nan).cast("double"))
        .when(F.abs(c) == F.lit(float("inf")), F.lit(inf))
        .otherwise(c)
    )


def start_end(c: Column | str) -> Column:
    """``12-15`` to a struct (start, end); a single number fills both, ``?`` leaves NULL."""
    c = column(c)
    low, high = F.split(c, "-").getItem(0), F.get(F.split(c, "-"), F.lit(1))
    ranged = c.contains("-")
    return F.struct(
        parse_int(F.when(ranged, low).otherwise(c)).alias("start"),
        parse_int(F.when(ranged, high).otherwise(c)).alias("end"),
    )


def first_position(c: Column | str) -> Column:
    """The first readable number of ``12``, ``12-15`` or ``?-15``."""
    span = start_end(c)
    return F.coalesce(span["start"], span["end"])


def pred_score(c: Column | str) -> Column:
    """``tolerated(0.12)`` to a struct (pred, score); a bare number is only a score."""
    c = column(c)
    pattern = r"^(.*?)\((.*)\)"
    paired = c.rlike(pattern)
    return F.struct(
        F.when(paired, F.regexp_extract(c, pattern, 1)).alias("pred"),
        F.when(paired, parse_float(F.regexp_extract(c, pattern, 2))).otherwise(parse_float(c)).alias("score"),
    )


# --- text --------------------------------------------------------------------------------

def blank_to_null(c: Column | str, *blanks: str) -> Column:
    c = column(c)
    return F.when(~c.isin("", *blanks), c)


def to_list(c: Column | str, sep: str) -> Column:
    """Split on a literal separator; an empty text is NULL, never ``['']``."""
    return F.split(blank_to_null(c), "\\Q" + sep + "\\E")


def decode_escapes(c: Column | str) -> Column:
    """``\\x3b``, ``\\x2c``, ``\\x3d`` to ``;``, ``,``, ``=``, then ``,_`` to ``_``."""
    out = column(c)
    for escaped, plain in (("\\x3b", ";"), ("\\x2c", ","), ("\\x3d", "="), (",_", "_")):
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return out


def tokens(c: Column | str, analyzer: str = "simple") -> Column:
    """Words of a text: lower-cased letter runs (``simple``) or as written (``whitespace``)."""
    c = column(c)
    parts = F.split(c, r"\s+") if analyzer == "whitespace" else F.split(F.lower(c), r"[^\p{L}]+")
    return F.filter(parts, lambda t: t != "")


def safe_name(name: str) -> str:
    """Dots are path separators, so field names use underscores."""
    return name.replace(".", "_")


def natural_key(c: Column | str) -> Column:
    """Sort key under which ``Brand#2`` comes before ``Brand#10``.

    Text and number runs alternate, text first. A number run is written as its length and its
    digits without leading zeros, so comparing text compares the numbers, whatever their size.
    """
    c = column(c).cast("string")
    runs = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))
    runs = F.when(c.rlike(r"^\d"), F.concat(F.array(F.lit("")), runs)).otherwise(runs)

    def encode(run: Column) -> Column:
        digits = F.regexp_replace(run, r"^0+(?=\d)", "")
        return F.when(run.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)).otherwise(run)

    return F.transform(runs, encode)


# --- variants ----------------------------------------------------------------------------

def display_id(chrom: Column | str, pos: Column | str, ref: Column | str, alt: Column | str, sep: str = "_") -> Column:
    """Readable id; alleles are cut at ten bases, so it is not unique."""
    return F.concat_ws(sep, column(chrom), column(pos).cast("string"),
                       F.substring(column(ref), 1, 10), F.substring(column(alt), 1, 10))


def variant_key(*parts: Column | str) -> Column:
    """Stable document id over all parts (chrom, pos, ref, alt, id, dataset ...)."""
    filled = [F.coalesce(column(p).cast("string"), F.lit(".")) for p in parts]
    return F.sha2(F.concat_ws("-", *filled), 224)


def variant_class(ref: Column | str, alt: Column | str, rule: str = "base") -> Column:
    """SNV or INDEL: by base letters (``base``) or by allele length (``length``)."""
    ref, alt = column(ref), column(alt)
    if rule == "length":
        snv = (F.length(ref) == 1) & (F.length(alt) == 1) & (ref != ".") & (alt != ".")
    else:
        snv = ref.isin("G", "A", "T", "C") & alt.isin("G", "A", "T", "C")
    return F.when(snv, "SNV").otherwise("INDEL")


def normalize_chrom(c: Column | str) -> Column:
    """``chr1`` to ``1``, ``chrX`` to ``X``."""
    return F.upper(F.trim(F.replace(F.lower(column(c)), F.lit("chr"), F.lit(""))))


def alt_count(gt: Column | str) -> Column:
    """Sum of the allele digits of a genotype."""
    digits = F.regexp_extract_all(column(gt), F.lit(r"(\d)"), F.lit(1))
    return F.aggregate(digits, F.lit(0), lambda total, d: total + d.cast("int"))


def region_string(variant: Column | str, flank: int = V.REGION_FLANK, kind: str = "browser") -> Column:
    """Position text of a display id for a genome browser or for a DECIPHER location."""
    chrom, pos = F.split_part(column(variant), F.lit("_"), F.lit(1)), F.split_part(column(variant), F.lit("_"), F.lit(2)).cast("long")
    window = F.concat((pos - flank).cast("string"), F.lit("-"), (pos + flank).cast("string"))
    if kind == "browser":
        named = F.when(F.lower(chrom).contains("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))
        return F.concat(named, F.lit(":"), window)
    bare = F.replace(chrom, F.lit("chr"), F.lit(""))
    point = F.concat(bare, F.lit(":"), pos.cast("string"), F.lit("-"), pos.cast("string"))
    return F.concat(bare, F.lit(":"), window, F.lit("/location/"), point)


def constant(value: list, kind: str) -> Column:
    """A list of any length as one literal; a literal per element would make the plan as long as the list."""
    return F.from_json(F.lit(json.dumps(value)), kind)

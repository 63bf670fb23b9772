"""INFO text to typed columns, field profiling and configured mappings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixloom.functions import vocab as V
from helixloom.functions.parsers import map_values, parser
from helixloom.functions.scalars import clean_number, decode_escapes, infer_type, parse_float, parse_int
from helixloom.sources.vcf import Catalog


def with_info(df: DataFrame) -> DataFrame:
    """Split INFO once into ``_keys`` and ``_values``, last entry first, so that a repeated key
    finds its last value. A value is everything after the first ``=``; a flag has NULL."""
    entries = F.reverse(F.split("INFO", ";"))
    keys = F.transform(entries, lambda e: F.replace(F.substring_index(e, "=", 1), F.lit("."), F.lit("_")))
    values = F.transform(entries, lambda e: F.when(e.contains("="), F.substr(e, F.locate("=", e) + 1)))
    return df.withColumns({"_keys": keys, "_values": values})


def info_value(name: str) -> Column:
    """Text of one field; ``.`` and absence are NULL."""
    at = F.array_position("_keys", name)
    v = F.get("_values", (at - 1).cast("int"))
    return F.when((at > 0) & (v != "."), v)


def cut_info(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add the text of each field as a column of its own, cut out once for all later uses."""
    return df.withColumns({_cut_name(n): info_value(n) for n in dict.fromkeys(names)})


def _cut_name(name: str) -> str:
    # Spark names ignore case and field names do not: their bytes tell CADD_phred and CADD_PHRED apart.
    return f"_info_{name.encode().hex()}"


def distinct_names(names: Sequence[str], taken: Sequence[str] = ()) -> dict[str, str]:
    """Column name of each field: its own, or with a number where that would meet another one but for case."""
    used, out = {t.lower() for t in taken}, {}
    for n in names:
        name, k = n, 2
        while name.lower() in used:
            name, k = f"{n}_{k}", k + 1
        used.add(name.lower())
        out[n] = name
    return out


def info_text(name: str) -> Column:
    """A field that ``cut_info`` has cut out."""
    return F.col(_cut_name(name))


def drop_cut(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_info_")])


def has_flag(name: str) -> Column:
    return F.array_contains("_keys", name)


# Fields built by the annotation functions or replaced by another field; not plain columns.
# Fixed values.
BUILT_ELSEWHERE = [
    "CSQ", "ANN", "LOF", "NMD", "Gene_refGene", "Gene_ensGene", "GeneDetail_refGene", "GeneDetail_ensGene",
    "AAChange_refGene", "AAChange_ensGene", "CLNSIG", "CLINSIG", "ICGC_Occurrence", "gwasCatalog",
    "tfbsConsSites", "targetScanS", "wgRna", "GTEx_V6_gene", "GTEx_V6_tissue", "dbSNP_ID", "COSMIC_ID",
]


def _built_elsewhere(name: str) -> bool:
    return name in BUILT_ELSEWHERE or name.startswith("CLN") or "cosmic" in name


def info_columns(types: Mapping[str, str], group: str | None = None,
                 dictionaries: Mapping[str, Mapping[str, str]] | None = None) -> dict[str, Column]:
    """Output name -> typed column for every plain field of the catalog, over fields cut out before.

    Cohort metrics get the group suffix. Unreadable numbers, NaN and ``.`` are NULL.
    """
    dictionaries = dictionaries or {}
    suffix = f"_{group.strip('_')}" if group else ""
    out: dict[str, Column] = {}
    for name, kind in types.items():
        if name in V.INFO_EXCLUDED or _built_elsewhere(name):
            continue
        target = name + (suffix if name in V.COHORT_FIELDS else "")
        raw = info_text(name)
        if kind == "flag":
            out[name] = F.when(has_flag(name), "Yes").otherwise("No")
        elif kind == "integer" and name in V.INFO_KEPT_AS_TEXT:
            out[name + (suffix if name == "FS" else "")] = raw
        elif kind == "integer":
            # Integer fields carry the cohort suffix whether or not they are cohort metrics.
            out[name + suffix] = parse_int(raw)
        elif kind == "float":
            out[target] = clean_number(parse_float(raw))
        elif name == "VT":
            out["VariantType"] = raw
        elif name == "ICGC_Id":
            out["ICGC_ID"] = raw
        elif "snp" in name and name != "snp138NonFlagged":
            out["_snp"] = F.coalesce(out["_snp"], raw) if "_snp" in out else raw
        elif name == "snp138NonFlagged":
            out[name] = raw
        else:
            text = F.replace(F.replace(raw, F.lit("\\x3d"), F.lit("=")), F.lit("\\x3b"), F.lit(";"))
            out[target] = map_values(text, dictionaries.get(name, {}))
    return out


def parse_info(df: DataFrame, types: Mapping[str, str], group: str | None = None,
               dictionaries: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """Add all plain INFO fields in one projection; ``_keys``/``_values`` stay for the builders."""
    df = df if "_keys" in df.columns else with_info(df)
    present = df.columns
    df = cut_info(df, [n for n, kind in types.items() if kind != "flag" and n not in V.INFO_EXCLUDED and not _built_elsewhere(n)])
    fields = info_columns(types, group, dictionaries)
    snp = fields.pop("_snp", None)
    if snp is not None:
        listed = F.when(snp.isNotNull(), F.array(snp))
        fields["dbSNP_ID"] = F.coalesce("dbSNP_ID", listed) if "dbSNP_ID" in present else listed
    if "VariantType" in fields and "VariantType" in present:
        fields["VariantType"] = F.coalesce(fields["VariantType"], F.col("VariantType"))
    # A field named like a core column, or like another field but for case, gets a number and overwrites nothing.
    meant = [n for n in ("dbSNP_ID", "VariantType") if n in fields]
    names = distinct_names([n for n in fields if n not in meant], [*[c for c in present if c not in meant], *meant])
    return drop_cut(df.withColumns({names.get(n, n): c for n, c in fields.items()}))


# --- profiling ---------------------------------------------------------------------------

def _typed(section: str, name: Column, value: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), name.alias("name"), value.alias("value"))


def profile_fields(df: DataFrame, csq_fields: Sequence[str] = ()) -> DataFrame:
    """Type and fill of every INFO, CSQ and FORMAT field, from all lines.

    A field is integer unless some value is a decimal (float) or other text (keyword); the widest
    type wins whatever the order of lines. Of a list its first element counts, ``.`` and empty
    values do not. The exploded values are reduced inside each task to one row per field.
    """
    df = df if "_keys" in df.columns else with_info(df)
    info = F.filter(
        F.transform(F.arrays_zip(F.col("_keys").alias("k"), F.col("_values").alias("v")), lambda e: _typed("INFO", e["k"], e["v"])),
        lambda e: e["name"] != "CSQ")
    lists = [info]
    if csq_fields:
        transcripts = F.split(info_value("CSQ"), ",")
        names = F.lit(list(csq_fields))
        lists.append(F.flatten(F.transform(transcripts, lambda t: F.transform(
            F.arrays_zip(names.alias("k"), F.split(t, r"\|").alias("v")), lambda e: _typed("CSQ", e["k"], e["v"])))))
    if "calls" in df.columns:
        lists.append(F.flatten(F.transform("calls", lambda call: F.transform(
            F.arrays_zip(F.split("format", ":").alias("k"), F.split(call, ":").alias("v")),
            lambda e: _typed("FORMAT", e["k"], e["v"])))))
    empty = F.array().cast("array<struct<section:string,name:string,value:string>>")
    every = F.concat(*[F.coalesce(x, empty) for x in lists])
    values = df.select(F.explode(every).alias("e")).select("e.*").filter(F.col("name").isNotNull() & (F.col("name") != ""))
    filled = F.col("value").isNotNull() & ~F.col("value").isin("", ".")
    head = F.substring_index(F.substring_index("value", ",", 1), "&", 1)
    values = values.select("section", "name", F.when(filled, head).alias("head"))
    text_only = F.col("name").endswith("GT") & (F.col("section") == "FORMAT")
    kind = infer_type("head")
    rank = F.when(text_only | (kind == "keyword"), 3).when(kind == "float", 2).otherwise(1)
    found = values.select("section", "name", F.when(F.col("head").isNotNull(), rank).alias("rank"))
    counted = found.groupBy("section", "name").agg(F.max("rank").alias("rank"), F.count("rank").alias("filled"), F.count(F.lit(1)).alias("seen"))
    names = F.when(F.col("rank") == 3, "keyword").when(F.col("rank") == 2, "float").when(F.col("rank") == 1, "integer")
    return counted.select("section", "name", names.alias("type"), "filled", "seen")


def refine_catalog(catalog: Catalog, profile: Sequence[Row]) -> Catalog:
    """Declared types corrected by the collected profile, which has one row per field."""
    found = {(r["section"], r["name"]): r["type"] for r in profile if r["type"]}
    info = {n: (t if t == "flag" else found.get(("INFO", n), t)) for n, t in catalog.info.items()}
    fmt = {n: ("string" if n == "PL" else found.get(("FORMAT", n), t)) for n, t in catalog.format.items()}
    return replace(catalog, info=info, format=fmt)


def csq_types(catalog: Catalog, profile: Sequence[Row] = ()) -> dict[str, str]:
    """Types of the VEP sub-fields: by name, then by profile."""
    found = {r["name"]: r["type"] for r in profile if r["section"] == "CSQ" and r["type"]}
    out = {}
    for f in catalog.csq_fields:
        declared = "keyword"
        if f.endswith("_AF") or f == "AF" or f.startswith("CADD") or f.endswith("score"):
            declared = "float"
        elif f == "DISTANCE":
            declared = "integer"
        out[f] = "float" if declared == "float" else found.get(f, declared)
    return out


# --- configured mapping ------------------------------------------------------------------

@dataclass
class FieldMapping:
    """How one INFO field is stored."""

    key: str
    target: str | None = None
    type: str = "keyword"
    default: object = None
    values: Mapping[str, str] = field(default_factory=dict)
    exists_only: bool = False
    overwrites: str | None = None
    parse_function: str | None = None
    parse_with: str | None = None
    nested_path: str | None = None


def _mapped(m: FieldMapping) -> Column:
    raw = decode_escapes(info_text(m.key))
    raw = F.when(raw != "nan", raw)
    if m.exists_only:
        return F.when(has_flag(m.key), F.lit(True))
    if m.parse_function:
        args = [raw] + ([decode_escapes(info_text(m.parse_with))] if m.parse_with else [])
        return parser(m.parse_function)(*args)
    if m.type == "integer":
        return F.transform(F.split(raw, ","), parse_int)
    if m.type == "float":
        return F.filter(F.transform(F.split(raw, ","), parse_float), lambda x: ~F.isnan(x))
    return map_values(raw, m.values)


def _same_members(df: DataFrame, first: Column, second: Column) -> tuple[Column, Column]:
    """Two arrays of structs with the members of both: what an element does not have is NULL."""
    kinds = [f.dataType for f in df.select(first.alias("a"), second.alias("b")).schema.fields]
    if kinds[0] == kinds[1] or not all(isinstance(k, T.ArrayType) and isinstance(k.elementType, T.StructType) for k in kinds):
        return first, second
    own = [{f.name: f.dataType for f in k.elementType.fields} for k in kinds]
    every = own[0] | {n: k for n, k in own[1].items() if n not in own[0]}

    def widened(values: Column, has: dict) -> Column:
        return F.transform(values, lambda e: F.struct(*[(e[n] if n in has else F.lit(None)).cast(k).alias(n) for n, k in every.items()]))

    return widened(first, own[0]), widened(second, own[1])


def apply_mapping(df: DataFrame, mapping: Sequence[FieldMapping]) -> DataFrame:
    """Store INFO fields as configured: constant defaults, dictionaries, renames, presence-only
    fields, named parsers (alone or over two fields), shared nested paths and overwritten targets.

    Numbers come as arrays because a value may be a list. Parts of one nested path are joined.
    """
    df = df if "_keys" in df.columns else with_info(df)
    df = cut_info(df, [k for m in mapping for k in (m.key, m.parse_with) if k])
    out: dict[str, Column] = {}
    for m in mapping:
        target = m.nested_path or m.target or m.key
        value = _mapped(m)
        if m.default is not None:
            value = F.coalesce(value, F.array(F.lit(m.default)) if m.type in ("integer", "float") and not m.parse_function else F.lit(m.default))
        if target in out and m.nested_path:
            first, second = _same_members(df, out[target], value)
            value = F.when(first.isNull(), second).when(second.isNull(), first).otherwise(F.concat(first, second))
        out[target] = value
    by_key = {m.key: (m.nested_path or m.target or m.key) for m in mapping}
    for m in mapping:
        if m.overwrites:
            base, over = by_key[m.overwrites], by_key[m.key]
            out[base] = F.coalesce(out[over], out[base])
    return drop_cut(df.withColumns(out))

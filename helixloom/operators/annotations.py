"""Annotation text to arrays of structs: transcripts, gene context, disease and track fields.

Every function takes text columns and returns columns, so a whole set of annotations is one
projection over the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.functions import vocab as V
from helixloom.functions.scalars import (
    blank_to_null, column, first_position, parse_float, parse_int, pred_score, start_end, to_list,
)

HEX_SEMICOLON = "\\x3b"
HEX_EQUALS = "\\x3d"


def _nth(parts: Column, i: int) -> Column:
    """The i-th piece; missing and empty pieces are NULL."""
    return blank_to_null(F.get(parts, F.lit(i)))


def _last(values: Column) -> Column:
    return F.get(values, F.size(values) - 1)


# --- VEP ---------------------------------------------------------------------------------

def split_transcripts(csq: Column | str) -> Column:
    """The VEP field as an array of transcripts, each an array of sub-field texts."""
    return F.transform(F.split(column(csq), ","), lambda t: F.split(t, r"\|"))


def build_consequences(transcripts: Column | str, fields: Sequence[str], types: Mapping[str, str] | None = None,
                       ranges: str = "first", global_rule: str = "last") -> tuple[Column, dict[str, Column]]:
    """Transcript array, and the variant-wide fields that every transcript repeats.

    ``transcripts`` comes from ``split_transcripts``, as a column of its own since it is read often.
    ``ranges``: positions such as ``12-15`` as first number or as ``_start``/``_end``.
    ``global_rule``: a variant-wide field takes the ``last`` filled transcript, or a value only
    where all filled transcripts are ``agreed``. Lists by ``&`` are arrays.
    """
    types, transcripts = dict(types or {}), column(transcripts)

    def members(t: Column) -> list[Column]:
        out = []
        for i, f in enumerate(fields):
            if f not in V.VEP_TRANSCRIPT_FIELDS:
                continue
            raw = _nth(t, i)
            if f in ("SIFT", "PolyPhen"):
                both = pred_score(raw)
                out += [both["pred"].alias(f + "_pred"), both["score"].alias(f + "_score")]
            elif f.endswith("_position") and ranges == "span":
                span = start_end(raw)
                out += [span["start"].alias(f + "_start"), span["end"].alias(f + "_end")]
            elif f == "Consequence":
                out.append(to_list(raw, "&").alias(f))
            elif types.get(f) == "integer":
                out.append(first_position(raw).cast("int").alias(f))
            elif f.endswith("score"):
                out.append(parse_float(raw).alias(f))
            else:
                out.append(raw.alias(f))
        return out

    nested = F.transform(transcripts, lambda t: F.struct(*members(t)))

    def pick(values: Column) -> Column:
        filled = F.filter(values, lambda v: v.isNotNull())
        if global_rule == "agreed":
            return F.when(F.size(F.array_distinct(filled)) == 1, F.get(filled, F.lit(0)))
        return _last(filled)

    def values_at(i: int) -> Column:
        return F.transform(transcripts, lambda t: _nth(t, i))

    def ids_of(lists: Column, prefix: str) -> Column:
        ids = F.transform(lists, lambda one: F.filter(one, lambda x: x.startswith(prefix)))
        return _last(F.filter(ids, lambda one: F.size(one) > 0))

    variant: dict[str, Column] = {}
    for i, f in enumerate(fields):
        if f in V.VEP_TRANSCRIPT_FIELDS or f in V.VEP_VARIANT_SKIPPED:
            continue
        values = values_at(i)
        if f == "Existing_variation":
            lists = F.transform(values, lambda v: F.split(v, "&"))
            variant["COSMIC_ID"], variant["dbSNP_ID"] = ids_of(lists, "COSM"), ids_of(lists, "rs")
            continue
        value = pick(values)
        if types.get(f) == "integer":
            variant[f] = F.transform(F.split(value, "&"), lambda x: parse_int(x).cast("int"))
        elif types.get(f) == "float":
            variant[f] = F.transform(F.split(value, "&"), parse_float)
        elif f in V.VEP_VARIANT_LISTS:
            variant[f] = F.split(value, "&")
        else:
            variant[f] = value
    return nested, variant


# --- ANNOVAR gene models -----------------------------------------------------------------

def build_gene_context(func: Column | str, gene: Column | str, detail: Column | str, db: str,
                       gene_always: bool = False) -> dict[str, Column]:
    """Neighbouring genes with distances, or the gene itself with its detail.

    ``upstream`` of a gene means the gene lies downstream, and the other way round. Without a
    detail nothing is set, so a gene of an exonic variant is then only in its transcripts;
    ``gene_always`` sets it all the same.
    """
    func, gene, detail = column(func), column(gene), column(detail)
    escaped = F.split(gene, r"\\x3b")
    genes = F.when(gene.contains("x3b"), escaped).otherwise(F.split(gene, ","))
    details = F.split(detail, r"\\x3b")
    near = F.coalesce(F.get(details, F.lit(0)).startswith("dist"), F.lit(False))

    def distance(i: int) -> Column:
        text = F.get(details, F.lit(i))
        return F.when(~text.contains("NONE"), parse_int(F.replace(text, F.lit("dist" + HEX_EQUALS), F.lit("")))).cast("int")

    def nth(i: int) -> Column:
        return F.get(genes, F.lit(i))

    between, below, above = func.isin(V.FUNC_BETWEEN), func == "downstream", func == "upstream"
    inside, detailed = func.isin(V.FUNC_IN_GENE), func.isin(V.FUNC_WITH_DETAIL)
    own = F.when(~near & inside & detail.isNotNull(), escaped).when(~near & detailed & detail.isNotNull(), F.slice(genes, 1, 1))
    if gene_always:
        own = F.coalesce(own, F.when(inside, escaped).when(detailed, F.slice(genes, 1, 1)))
    return {
        f"Upstream_{db}": F.when(near & (below | between), nth(0)),
        f"Downstream_{db}": F.when(near & above, nth(0)).when(near & between, nth(1)),
        f"Distance_to_upstream_{db}": F.when(near & (below | between), distance(0)),
        f"Distance_to_downstream_{db}": F.when(near & above, distance(0)).when(near & between, distance(1)),
        f"Gene_{db}": own,
        f"GeneDetail_{db}": F.when(~near & detailed & detail.isNotNull(), details),
    }


# Member names of a transcript change, in the order of its parts.
AACHANGE_MEMBERS = {
    "refGene": ["Gene", "RefSeq", "exon_id_rg", "cdna_change_rg", "aa_change_rg"],
    "ensGene": ["Ensembl_Gene_ID", "Ensembl_Transcript_ID", "exon_id_eg", "cdna_change_eg", "aa_change_eg"],
}


def build_aachange(c: Column | str, db: str, min_parts: int = 5) -> Column:
    """``gene:transcript:exon:c.:p.`` entries with at least ``min_parts`` (3, 4 or 5) parts."""
    parts = F.transform(F.split(column(c), ","), lambda e: F.split(e, ":"))
    kept = F.filter(parts, lambda p: (F.size(p) >= min_parts) & (F.size(p) <= 5) & (F.lower(p[0]) != "unknown"))
    names = AACHANGE_MEMBERS[db]
    built = F.transform(kept, lambda p: F.struct(*[F.get(p, F.lit(i)).alias(n) for i, n in enumerate(names)]))
    return F.when(F.lower(column(c)) != "unknown", built)


def build_gene_records(gene: Column | str, detail: Column | str, db: str) -> Column:
    """Gene records of the configured importer: distance text, or one record per transcript detail."""
    gene, detail = column(gene), column(detail)
    # Transcript prefixes and member names.
    prefix, names = {
        "refGene": ("N", ["refGene_symbol", "refGene_refgene_id", "refGene_location", "refGene_cDNA_change", "refGene_distance_to_gene"]),
        "ensGene": ("ENST", ["ensGene_gene_id", "ensGene_transcript_id", "ensGene_location", "ensGene_cDNA_change", "ensGene_distance_to_gene"]),
    }[db]
    symbol = F.array_join(F.split(gene, "[;,]"), " ")

    def record(transcript: Column, location: Column, change: Column, distance: Column) -> Column:
        parts = [symbol, transcript, location, change, distance]
        return F.struct(*[p.cast("string").alias(n) for p, n in zip(parts, names)])

    none = F.lit(None)

    def by_prefix(parts: Column, p: str) -> Column:
        return _last(F.filter(parts, lambda x: x.startswith(p)))

    def from_detail(entry: Column) -> Column:
        parts = F.split(entry, ":")
        return record(by_prefix(parts, prefix), by_prefix(parts, "exon"), by_prefix(parts, "c."), none)

    return (
        F.when(gene.isNull(), F.lit(None))
        .when(detail.isNull(), F.array(record(none, none, none, none)))
        .when(detail.rlike("^dist=[a-zA-Z0-9]+;dist=[a-zA-Z0-9]+$"), F.array(record(none, none, none, detail)))
        .when(detail.contains(":"), F.transform(F.split(detail, "[;,]"), from_detail))
    )


def prune_nested(c: Column | str, key: str, details: Sequence[str]) -> Column:
    """Drop elements that only repeat a key another element describes more fully."""
    c = column(c)

    def wanted(e: Column) -> Column:
        alone = F.size(F.filter(c, lambda x: x[key].eqNullSafe(e[key]))) == 1
        detailed = F.lit(False)
        for d in details:
            detailed = detailed | e[d].isNotNull()
        return alone | detailed

    return F.filter(c, wanted)


# --- disease and tissue ------------------------------------------------------------------

def zip_lists(sep: str, **texts: Column) -> Column:
    """Align lists by position into structs; shorter lists give NULL."""
    zipped = F.arrays_zip(*[F.split(t, sep).alias(n) for n, t in texts.items()])
    return zipped


def zip_clinvar(sig: Column | str, disease: Column | str, review: Column | str) -> Column:
    sig, empty = column(sig), F.lit("")
    built = zip_lists(r"\|", CLNSIG=sig, CLNDN=F.coalesce(column(disease), empty), CLNREVSTAT=F.coalesce(column(review), empty))
    return F.transform(built, lambda e: F.struct(*[blank_to_null(e[n]).alias(n) for n in ("CLNSIG", "CLNDN", "CLNREVSTAT")]))


def zip_clinvar_accessions(sig: Column | str, disease: Column | str, accession: Column | str) -> Column:
    """The older field set of the configured importer, split on runs of ``,`` or ``|``."""
    return zip_lists(r",+|\|+", clinvar_CLINSIG=column(sig), clinvar_CLNDBN=column(disease), clinvar_CLNACC=column(accession))


def zip_gtex(genes: Column | str, tissues: Column | str) -> Column:
    return zip_lists(r"\|", GTEx_V6_gene=column(genes), GTEx_V6_tissue=column(tissues))


def parse_cosmic(c: Column | str) -> tuple[Column, Column]:
    """``ID=..;OCCURENCE=1(site),2(site)`` (escaped or plain) to ids and an occurrence array."""
    c = column(c)
    pattern = r"^[^=\\]*(?:=|\\x3d)(.*?)(?:;|\\x3b)[^=\\]*(?:=|\\x3d)(.*)$"
    ids = F.split(blank_to_null(F.regexp_extract(c, pattern, 1)), ",")
    entries = F.split(blank_to_null(F.regexp_extract(c, pattern, 2)), ",")
    sites = F.transform(entries, lambda e: F.struct(
        parse_int(F.substring_index(e, "(", 1)).cast("int").alias("COSMIC_Occurrence"),
        F.regexp_extract(e, r"\((.*?)\)", 1).alias("COSMIC_Cancer_Site")))
    return ids, sites


def parse_icgc(c: Column | str) -> Column:
    """``site|mutated|total|frequency`` entries."""
    def build(e: Column) -> Column:
        p = F.split(e, r"\|")
        return F.struct(
            F.get(p, F.lit(0)).alias("ICGC_Cancer_Site"), parse_int(F.get(p, F.lit(1))).cast("int").alias("ICGC_Allele_Count"),
            parse_int(F.get(p, F.lit(2))).cast("int").alias("ICGC_Allele_Number"),
            parse_float(F.get(p, F.lit(3))).alias("ICGC_Allele_Frequency"))

    return F.transform(F.split(column(c), ","), build)


# --- tracks ------------------------------------------------------------------------------

def _without(c: Column, prefix: str) -> Column:
    return F.replace(F.replace(c, F.lit(prefix + HEX_EQUALS), F.lit("")), F.lit(prefix + "="), F.lit(""))


def parse_gwas(c: Column | str) -> Column:
    """Trait list without the ``Name=`` prefix and leading underscores."""
    return F.transform(F.split(_without(column(c), "Name"), ","), lambda x: F.regexp_replace(x, "^_", ""))


def parse_score_name(c: Column | str, name: str) -> dict[str, Column]:
    """``Score=..;Name=..`` to two columns; other shapes give NULL."""
    parts = F.split(column(c), r";|\\x3b")
    two = F.size(parts) == 2
    return {
        f"{name}_Score": F.when(two, parse_int(_without(parts[0], "Score"))).cast("int"),
        f"{name}_Name": F.when(two, _without(parts[1], "Name")),
    }


def parse_name(c: Column | str) -> Column:
    return _without(column(c), "Name")


# --- SnpEff and generic piped lists ------------------------------------------------------

def clean_field(name: str) -> str:
    return name.strip().replace(".", "_").replace(" ", "")


def piped_to_structs(c: Column | str, fields: Sequence[str], strip_parens: bool = False, prefix: str = "") -> Column:
    """Comma-separated entries of ``|``-separated values; empty values are NULL."""
    def build(e: Column) -> Column:
        text = F.substr(e, F.lit(2), F.length(e) - 2) if strip_parens else e
        parts = F.split(text, r"\|")
        return F.struct(*[_nth(parts, i).alias(prefix + clean_field(f)) for i, f in enumerate(fields)])

    return F.transform(F.split(column(c), ","), build)


def build_snpeff(c: Column | str, kind: str, fields: Sequence[str]) -> Column:
    """ANN (pairs ``a/b`` split, numbers, ``&`` lists) or LOF/NMD (parentheses, numbers)."""
    names = [clean_field(f) for f in fields]
    prefix = "ANN_nested_" if kind == "ANN" else f"{kind}_"

    def build(e: Column) -> Column:
        text = e if kind == "ANN" else F.substr(e, F.lit(2), F.length(e) - 2)
        parts = F.split(text, r"\|")
        members = []
        for i, n in enumerate(names):
            raw = _nth(parts, i)
            if kind == "ANN" and n in V.ANN_PAIRS:
                for j, half in enumerate(n.split("/")):
                    members.append(parse_int(F.get(F.split(raw, "/"), F.lit(j))).cast("int").alias(prefix + half))
            elif kind == "ANN" and n in V.ANN_LISTS:
                members.append(F.split(raw, "&").alias(prefix + n))
            elif n in V.ANN_INTEGERS + V.EFFECT_INTEGERS:
                members.append(parse_int(F.substring_index(raw, "&", 1)).cast("int").alias(prefix + n))
            elif n in V.EFFECT_FLOATS:
                members.append(parse_float(F.substring_index(raw, "&", 1)).alias(prefix + n))
            else:
                members.append(raw.alias(prefix + n))
        return F.struct(*members)

    return F.transform(F.split(column(c), ","), build)


def ancestral_allele(c: Column | str) -> Column:
    """``AA|REF|ALT|IndelType`` to an array of at most one struct; ``.`` and empty are NULL."""
    parts = F.split(column(c), r"\|")
    members = ["AA_AA", "AA_REF", "AA_ALT", "AA_IndelType"]
    values = [blank_to_null(F.get(parts, F.lit(i)), ".") for i in range(4)]
    return F.when(F.coalesce(*values).isNotNull(), F.array(F.struct(*[v.alias(m) for v, m in zip(values, members)])))


# --- all fields of one file --------------------------------------------------------------

def annotate(df: DataFrame, info_types: Mapping[str, str], csq_fields: Sequence[str] = (),
             csq_types: Mapping[str, str] | None = None, subfields: Mapping[str, Sequence[str]] | None = None,
             gene_always: bool = False) -> DataFrame:
    """Add every nested annotation the header declares, in one projection."""
    from helixloom.operators.info import cut_info, drop_cut, info_text, info_value, with_info

    df = df if "_keys" in df.columns else with_info(df)
    columns = df.columns
    needed = ["GTEx_V6_tissue", *info_types, *(subfields or {})]
    for db in ("refGene", "ensGene"):
        needed += [f"Func_{db}", f"GeneDetail_{db}"]
    df = cut_info(df, [n for n in dict.fromkeys(needed) if n != "CSQ"])
    out: dict[str, Column] = {}
    if csq_fields:
        df = df.withColumns({"_info_parts": split_transcripts(info_value("CSQ"))})
        nested, variant = build_consequences("_info_parts", csq_fields, csq_types)
        out["CSQ_nested"] = nested
        out.update(variant)
    for db in ("refGene", "ensGene"):
        if f"Gene_{db}" in info_types:
            out.update(build_gene_context(info_text(f"Func_{db}"), info_text(f"Gene_{db}"), info_text(f"GeneDetail_{db}"), db, gene_always))
        if f"AAChange_{db}" in info_types:
            out[f"AAChange_{db}"] = build_aachange(info_text(f"AAChange_{db}"), db)
    for sig in ("CLNSIG", "CLINSIG"):
        if sig in info_types:
            disease, review = [info_text(n) if n in info_types else F.lit(None).cast("string") for n in ("CLNDN", "CLNREVSTAT")]
            out["CLNVAR_nested"] = zip_clinvar(info_text(sig), disease, review)
    if "ICGC_Occurrence" in info_types:
        out["ICGC_nested"] = parse_icgc(info_text("ICGC_Occurrence"))
    if "GTEx_V6_gene" in info_types:
        out["GTEx_nested"] = zip_gtex(info_text("GTEx_V6_gene"), info_text("GTEx_V6_tissue"))
    if "gwasCatalog" in info_types:
        out["gwasCatalog"] = parse_gwas(info_text("gwasCatalog"))
    if "wgRna" in info_types:
        out["wgRna"] = parse_name(info_text("wgRna"))
    for track in ("tfbsConsSites", "targetScanS"):
        if track in info_types:
            out.update(parse_score_name(info_text(track), track))
    for name in info_types:
        if "cosmic" in name:
            out["COSMIC_ID"], out["COSMIC_nested"] = parse_cosmic(info_text(name))
    for kind in ("ANN", "LOF", "NMD"):
        if subfields and kind in subfields:
            out["ANN_nested" if kind == "ANN" else kind] = build_snpeff(info_text(kind), kind, subfields[kind])
    for name in ("dbSNP_ID", "COSMIC_ID"):
        if name in out and name in columns:
            out[name] = F.coalesce(out[name], F.col(name))
    return drop_cut(df.withColumns(out))

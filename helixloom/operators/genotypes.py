"""Sample columns to genotype rows, and what the pedigree adds to them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.functions import vocab as V
from helixloom.functions.scalars import clean_number, column, constant, parse_float, parse_int
from helixloom.operators.sizing import broadcast_if, is_small


def _starts_with_any(c: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def is_no_call(call: Column | str) -> Column:
    """The sample text starts with a missing call. ``./0`` is not one of the known forms."""
    return _starts_with_any(column(call), V.NO_CALL_PREFIXES)


def is_hom_ref(call: Column | str) -> Column:
    call = column(call)
    return _starts_with_any(call, V.HOM_REF_PREFIXES) | (call == "0")


def unpivot_genotypes(df: DataFrame, samples: Sequence[str], keys: Sequence[str],
                      types: Mapping[str, str] | None = None, keep_homref: bool = True,
                      nocall: str = "drop", group: str | None = None) -> DataFrame:
    """One row per variant and sample from ``format`` and the array ``calls``. No shuffle.

    ``samples`` are the column headings of the file and ``types`` its FORMAT fields with
    integer/float/string. AD becomes AD_ref and AD_alt, comma values of other fields are
    dropped, PL and the genotype texts stay text. ``nocall``: ``drop`` them, ``keep`` them (for
    parent lookups, then ``drop_uncalled``) or read them as ``homref``.
    """
    named = F.arrays_zip(constant(list(samples), "array<string>").alias("Sample_ID"), F.col("calls").alias("call"))
    rows = df.select(*keys, "format", F.explode(named).alias("_s"))
    # A sample that the line's file does not have has no call there.
    rows = rows.select(*keys, "format", "_s.Sample_ID", F.col("_s.call").alias("_call")).filter(F.col("_call").isNotNull())
    return _typed_calls(rows, [*keys, "Sample_ID"], types, keep_homref, nocall, group)


def _typed_calls(rows: DataFrame, keys: Sequence[str], types: Mapping[str, str] | None, keep_homref: bool,
                 nocall: str = "drop", group: str | None = None) -> DataFrame:
    """FORMAT fields of one call per row, after the filters that need only the call's text."""
    types = dict(types or {})
    missing_call = F.lit(False)
    if nocall == "homref":
        missing_call = F.split_part("_call", F.lit(":"), F.lit(1)).isin("./.", ".")
    elif nocall == "drop":
        rows = rows.filter(~is_no_call("_call"))
    if not keep_homref:
        rows = rows.filter(~is_hom_ref("_call"))
    rows = rows.select(*keys, "_call", F.split("format", ":").alias("_format"), F.split("_call", ":").alias("_values"))
    names = list(dict.fromkeys(["GT", "AD", "DP", *types]))
    # Each field is cut out once, before the typing below uses it several times.
    cut = rows.select(*keys, "_call", missing_call.alias("_missing"), *[
        F.get("_values", F.array_position("_format", n).cast("int") - 1).alias(f"_f{i}") for i, n in enumerate(names)])
    cut = cut.select(*keys, "_call", "_missing", *[
        F.when(~F.col("_missing") & (F.col(f"_f{i}") != "."), F.col(f"_f{i}")).alias(f"_r{i}") for i in range(len(names))])

    def raw(name: str) -> Column:
        return F.col(f"_r{names.index(name)}")

    def scalar(name: str) -> Column:
        return F.when(~raw(name).contains(","), raw(name))

    def depth(i: int) -> Column:
        piece = F.when(raw("AD").contains(","), F.split_part(raw("AD"), F.lit(","), F.lit(i)))
        return F.when(F.col("_missing"), F.lit(0)).otherwise(parse_int(piece)).cast("int")

    out = [F.when(F.col("_missing"), "0/0").otherwise(raw("GT")).alias("GT"), depth(1).alias("AD_ref"), depth(2).alias("AD_alt"),
           parse_int(scalar("DP")).cast("int").alias("DP")]
    out += [raw(name).alias(name) for name in ("PL", "PGT", "PID") if name in types]
    for name, kind in types.items():
        if name in ("GT", "AD", "DP", "PL", "PGT", "PID"):
            continue
        if kind == "float":
            out.append(clean_number(parse_float(scalar(name))).alias(name))
        elif kind == "integer":
            out.append(parse_int(scalar(name)).cast("int").alias(name))
    if group is not None:
        out.append(F.lit(group.strip("_")).alias("group"))
    return cut.select(*keys, *out, *(["_call"] if nocall == "keep" else []))


def drop_uncalled(g: DataFrame, keep_homref: bool = True) -> DataFrame:
    """The filter that ``nocall='keep'`` put off until parents had been looked up."""
    g = g.filter(~is_no_call("_call"))
    if not keep_homref:
        g = g.filter(~is_hom_ref("_call"))
    return g.drop("_call")


def enrich_pedigree(ped: DataFrame) -> DataFrame:
    """Pedigree rows under their genotype-row names, with both parents' phenotypes."""
    parents = ped.select(F.col("sample").alias("_p"), F.col("phenotype").alias("_ph"))
    father = parents.toDF("_f", "Father_Phenotype")
    mother = parents.toDF("_m", "Mother_Phenotype")
    joined = (ped.join(father, ped["father"] == F.col("_f"), "left")
              .join(mother, ped["mother"] == F.col("_m"), "left"))
    return joined.select(
        F.col("sample").alias("Sample_ID"), F.col("family").alias("Family_ID"), F.col("father").alias("Father_ID"),
        F.col("mother").alias("Mother_ID"), F.col("sex").alias("Sex"), F.col("phenotype").alias("Phenotype"),
        F.col("age").alias("Age"), "Father_Phenotype", "Mother_Phenotype",
        F.col("affected_sibs_id").alias("Affected_Siblings_IDs"),
        F.col("affected_sibs_sex").alias("Affected_Siblings_Sex"),
        F.col("affected_sibs_age").alias("Affected_Siblings_Ages"),
        F.col("unaffected_sibs_id").alias("Unaffected_Siblings_IDs"),
        F.col("unaffected_sibs_sex").alias("Unaffected_Siblings_Sex"),
        F.col("unaffected_sibs_age").alias("Unaffected_Siblings_Ages"),
    )


def _addresses(ped: DataFrame, siblings: bool) -> DataFrame:
    """Who needs whose genotype: giver, receiver, role and place in a list of siblings."""
    none = F.lit(None).cast("int")
    parts = [ped.select(F.col(role).alias("_giver"), F.col("sample").alias("_receiver"), F.lit(role).alias("_role"), none.alias("_place"))
             for role in ("father", "mother")]
    if siblings:
        parts += [ped.select(F.posexplode(F.split(f"{role}_sibs_id", ",")).alias("_place", "_giver"), F.col("sample").alias("_receiver"), F.lit(role).alias("_role"))
                  .select("_giver", "_receiver", "_role", "_place") for role in ("affected", "unaffected")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("_giver").isNotNull())


def join_pedigree(genotypes: DataFrame, ped: DataFrame, keys: Sequence[str], siblings: bool = False) -> DataFrame:
    """Family, sex, phenotypes and the parents' (and siblings') genotypes at the same variant.

    Rows are cut to the genotype and sent to all who need them by one table of addresses, made from the
    pedigree, which is counted first and broadcast only while small. What a child receives is put
    together in one aggregation and met with its own row by (variant, sample): the genotypes are read
    twice, and no key is larger than a family. Beyond the bound the addresses are joined by
    shuffle, where adaptive execution splits the samples' rows. ``keys`` identify a variant line. Give genotypes
    from before no-call filtering, since a parent's missing call must still be seen.
    """
    small = is_small(ped)
    known = enrich_pedigree(ped)
    attributes = [c for c in genotypes.columns if c not in keys and c != "Sample_ID"]
    gifts = (genotypes.select(*keys, F.col("Sample_ID").alias("_giver"), F.col("GT").alias("_gt"))
             .join(broadcast_if(small, _addresses(ped, siblings)), "_giver"))

    def listed(role: str) -> Column:
        mine = F.sort_array(F.collect_list(F.when(F.col("_role") == role, F.struct("_place", "_gt"))))
        return F.when(F.size(mine) > 0, F.array_join(F.transform(mine, lambda x: x["_gt"]), ","))

    received = {f"{r.capitalize()}_Genotype": F.max(F.when(F.col("_role") == r, F.col("_gt"))) for r in ("father", "mother")}
    if siblings:
        received |= {f"{r.capitalize()}_Siblings_Genotypes": listed(r) for r in ("affected", "unaffected")}
    found = list(received)
    given = gifts.groupBy(*keys, F.col("_receiver").alias("Sample_ID")).agg(*[c.alias(n) for n, c in received.items()])
    out = genotypes.join(given, [*keys, "Sample_ID"], "left")
    return out.join(broadcast_if(small, known), "Sample_ID", "left").select(
        *keys, "Sample_ID", *attributes, *[c for c in known.columns if c != "Sample_ID"], *found)


def join_siblings(genotypes: DataFrame, ped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``join_pedigree`` with the affected and unaffected siblings' genotypes in list order."""
    return join_pedigree(genotypes, ped, keys, siblings=True)


def trios(ped: DataFrame) -> DataFrame:
    """Every child whose two parents are known."""
    known = ped.filter(F.col("father").isNotNull() & F.col("mother").isNotNull())
    return known.select(F.col("family").alias("Family_ID"), F.col("sample").alias("child"), "father", "mother",
                        F.col("sex").alias("child_sex"))


def sample_arrays(genotypes: DataFrame, keys: Sequence[str], path: str = "sample") -> DataFrame:
    """The array view of genotype rows: one document per variant.

    A variant has one row per sample column of the file, so the arrays are bounded by the headings.
    """
    from helixloom.operators.nesting import nest

    return nest(genotypes, keys, path, [c for c in genotypes.columns if c not in keys])


def family_elements(df: DataFrame, path: str, family: str, field: str = "Family_ID") -> DataFrame:
    """Keep only the array elements of one family."""
    return df.withColumns({path: F.filter(path, lambda e: F.coalesce(e[field] == family, F.lit(False)))})


def unpivot_with_pedigree(df: DataFrame, samples: Sequence[str], keys: Sequence[str], ped: DataFrame,
                          types: Mapping[str, str] | None = None, keep_homref: bool = True, siblings: bool = False) -> DataFrame:
    """``unpivot_genotypes`` and ``join_pedigree`` in one pass over the lines, without a shuffle.

    All samples of a variant stand in one line, so a relative's call is another element of the same
    array. Where each relative stands follows from the headings and the pedigree; those are a few
    numbers per sample column, read here once.
    """
    place = {s: i + 1 for i, s in enumerate(samples)}
    wanted = ped.filter(F.col("sample").isin(list(samples))).select(
        "sample", "father", "mother", F.split("affected_sibs_id", ",").alias("affected"), F.split("unaffected_sibs_id", ",").alias("unaffected"))
    relatives = {r["sample"]: r for r in wanted.collect()}

    def parent(role: str) -> Column:
        return constant([place.get(relatives[s][role], 0) if s in relatives else 0 for s in samples], "array<int>")

    def listed(role: str) -> Column:
        ids = [(relatives[s][role] if s in relatives else None) or [] for s in samples]
        return constant([[place[x] for x in one if x in place] or [0] for one in ids], "array<array<int>>")

    cut = df.select(*keys, "format", "calls", F.transform("calls", lambda c: F.split_part(c, F.lit(":"), F.lit(1))).alias("_gts"))

    def gt(p: Column) -> Column:
        return F.when(p > 0, F.get("_gts", p - 1))

    def joined(places: Column) -> Column:
        return F.when(places[0] > 0, F.array_join(F.transform(places, gt), ","))

    found = {"Father_Genotype": F.transform(parent("father"), gt), "Mother_Genotype": F.transform(parent("mother"), gt)}
    if siblings:
        found["Affected_Siblings_Genotypes"] = F.transform(listed("affected"), joined)
        found["Unaffected_Siblings_Genotypes"] = F.transform(listed("unaffected"), joined)
    zipped = F.arrays_zip(constant(list(samples), "array<string>").alias("Sample_ID"), F.col("calls").alias("_call"), *[c.alias(n) for n, c in found.items()])
    rows = cut.select(*keys, "format", F.explode(zipped).alias("_s")).select(*keys, "format", "_s.*")
    typed = _typed_calls(rows, [*keys, "Sample_ID", *found], types, keep_homref)
    return typed.join(broadcast_if(is_small(ped), enrich_pedigree(ped)), "Sample_ID", "left")

"""Inheritance modes of a child's variants.

All rules read one genotype row that already carries the parents' genotypes and phenotypes
(see ``genotypes.join_pedigree``) plus CHROM, POS and a boolean ``lof``. Six of the seven modes
are therefore plain row conditions; only compound heterozygosity looks across variants.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.functions import vocab as V
from helixloom.operators.predicates import Nested, nested_term, nested_terms, not_terms, outside


def _is(name: str, values: Sequence[str] | str) -> Column:
    return F.col(name).isin(values) if isinstance(values, list) else F.col(name) == values


def _autosomal() -> Column:
    return not_terms("CHROM", ["X", "Y"])


def _parents(phenotype: str) -> Column:
    return _is("Father_Phenotype", phenotype) & _is("Mother_Phenotype", phenotype)


def outside_par(assembly: str = "hg19", pos: str = "POS") -> Column:
    """On X outside both pseudo-autosomal intervals of the assembly; their bounds stay in."""
    test = F.col("CHROM") == "X"
    for low, high in V.PAR[assembly]:
        test = test & outside(pos, low, high)
    return test


def lof_condition(consequences: Column | None = None, columns: Sequence[str] = ()) -> Column:
    """Loss of function by VEP consequences (array of terms) or by any ANNOVAR gene model."""
    tests = []
    if consequences is not None:
        tests.append(F.arrays_overlap(consequences, F.lit(V.LOF_CONSEQUENCES)))
    for c in columns:
        if c.startswith("ExonicFunc"):
            tests.append(F.col(c).isin(V.LOF_EXONIC))
        elif c.startswith("Func"):
            tests.append(F.col(c) == V.LOF_FUNC)
    return F.coalesce(reduce(or_, [F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False))


def autosomal_recessive(lof: str = "lof") -> Column:
    return (_autosomal() & _is("GT", V.HOM_ALT) & _is("Phenotype", V.AFFECTED) & _parents(V.UNAFFECTED)
            & _is("Father_Genotype", V.HET) & _is("Mother_Genotype", V.HET) & F.col(lof))


def denovo(strict: bool = False) -> Column:
    """``strict`` accepts only the unphased ``0/0`` in the parents."""
    reference = ["0/0"] if strict else V.HOM_REF
    return (_autosomal() & _is("GT", V.HET) & _is("Phenotype", V.AFFECTED) & _parents(V.UNAFFECTED)
            & _is("Father_Genotype", reference) & _is("Mother_Genotype", reference))


def _affected_parent_transmits(affected: str, other: str) -> Column:
    return (_is(f"{affected}_Phenotype", V.AFFECTED) & ~F.coalesce(_is(f"{other}_Phenotype", V.AFFECTED), F.lit(False))
            & _is(f"{affected}_Genotype", V.HET) & _is(f"{other}_Genotype", V.HOM_REF))


def autosomal_dominant() -> Column:
    """Exactly one affected parent, who carries the variant while the other does not."""
    return (_autosomal() & _is("GT", V.HET) & _is("Phenotype", V.AFFECTED)
            & (_affected_parent_transmits("Mother", "Father") | _affected_parent_transmits("Father", "Mother")))


def x_linked_dominant(assembly: str = "hg19") -> Column:
    mother_affected = (_is("Mother_Genotype", V.HET) & _is("Mother_Phenotype", V.AFFECTED)
                       & _is("Father_Genotype", V.X_REF) & _is("Father_Phenotype", V.UNAFFECTED))
    father_affected = (_is("Mother_Genotype", V.HOM_REF) & _is("Mother_Phenotype", V.UNAFFECTED)
                       & _is("Father_Genotype", V.X_FATHER_CARRIER) & _is("Father_Phenotype", V.AFFECTED))
    male = _is("Sex", V.MALE) & _is("GT", V.X_MALE_DOMINANT) & mother_affected
    female = _is("Sex", V.FEMALE) & _is("GT", V.HET) & (mother_affected | father_affected)
    return outside_par(assembly) & _is("Phenotype", V.AFFECTED) & (male | female)


def x_linked_recessive(assembly: str = "hg19", lof: str = "lof") -> Column:
    mother_carries = _is("Mother_Genotype", V.HET) & _is("Mother_Phenotype", V.UNAFFECTED)
    male = _is("Sex", V.MALE) & not_terms("GT", V.X_REF)
    female = (_is("Sex", V.FEMALE) & _is("GT", V.HOM_ALT)
              & _is("Father_Genotype", V.X_FATHER_CARRIER) & _is("Father_Phenotype", V.AFFECTED))
    return (outside_par(assembly) & _is("Phenotype", V.AFFECTED) & F.col(lof) & mother_carries & (male | female))


def x_linked_denovo(assembly: str = "hg19") -> Column:
    carrier = (_is("Sex", V.MALE) & _is("GT", V.X_MALE_DENOVO)) | (_is("Sex", V.FEMALE) & _is("GT", V.HET))
    return (outside_par(assembly) & _is("Phenotype", V.AFFECTED) & _parents(V.UNAFFECTED)
            & _is("Father_Genotype", V.X_REF) & _is("Mother_Genotype", V.X_REF) & carrier)


def row_modes(assembly: str = "hg19", strict: bool = False, lof: str = "lof") -> dict[str, Column]:
    """The six modes decided by one row, as never-NULL conditions."""
    found = {
        "autosomal_recessive": autosomal_recessive(lof),
        "denovo": denovo(strict),
        "autosomal_dominant": autosomal_dominant(),
        "x_linked_dominant": x_linked_dominant(assembly),
        "x_linked_recessive": x_linked_recessive(assembly, lof),
        "x_linked_denovo": x_linked_denovo(assembly),
    }
    return {m: F.coalesce(c, F.lit(False)) for m, c in found.items()}


# --- compound heterozygosity -------------------------------------------------------------

def compound_candidate() -> Column:
    return (_autosomal() & _is("GT", V.HET) & _is("Phenotype", V.AFFECTED) & _parents(V.UNAFFECTED)
            & (_from_mother() | _from_father()))


def _from_mother() -> Column:
    return _is("Mother_Genotype", V.HET) & _is("Father_Genotype", V.HOM_REF)


def _from_father() -> Column:
    return _is("Father_Genotype", V.HET) & _is("Mother_Genotype", V.HOM_REF)


def compound_pairs(hits: DataFrame, child: str = "Sample_ID") -> DataFrame:
    """(child, gene) with a maternal and a paternal variant among candidate rows.

    Two booleans per group, combined map-side: a gene with very many variants costs no more
    than a small one, and no pairs of variants are formed.
    """
    return (hits.groupBy(child, "gene")
            .agg(F.max(F.coalesce(_from_mother(), F.lit(False))).alias("_m"),
                 F.max(F.coalesce(_from_father(), F.lit(False))).alias("_f"))
            .filter("_m and _f").select(child, "gene"))


def _gene_rows(g: DataFrame, genes: DataFrame | str, variant: str) -> DataFrame:
    """Candidate rows once per gene in which their variant is loss-of-function."""
    candidates = g.filter(compound_candidate())
    if isinstance(genes, str):
        rest = [c for c in g.columns if c not in ("gene", genes)]
        return candidates.select(*rest, F.explode(F.array_distinct(genes)).alias("gene"))
    return candidates.drop("gene").join(genes.select(variant, "gene").distinct(), variant)


def compound_het(g: DataFrame, genes: DataFrame | str, variant: str = "variant_key", child: str = "Sample_ID") -> DataFrame:
    """Candidate rows of every (child, gene) that has a maternal and a paternal variant.

    ``genes`` is the array column of genes in which the row's variant is loss-of-function, which
    needs no join, or a table (variant, gene). All candidates of a qualifying gene are returned.
    """
    hits = _gene_rows(g, genes, variant)
    return hits.join(compound_pairs(hits, child), [child, "gene"], "left_semi")


def candidate_genes(g: DataFrame, genes: DataFrame, variant: str = "variant_key") -> DataFrame:
    """Genes with a heterozygous variant in an affected child of unaffected parents."""
    rows = g.filter(_autosomal() & _is("GT", V.HET) & _is("Phenotype", V.AFFECTED) & _parents(V.UNAFFECTED))
    found = genes.filter(F.col("gene") != "").join(rows.select(variant).distinct(), variant, "left_semi")
    return found.select("gene").distinct()


# --- tagging and reading tags ------------------------------------------------------------

def _mark_compound(g: DataFrame, genes: DataFrame | str, variant: str, child: str) -> DataFrame:
    """Add ``_compound``: a candidate row one of whose genes qualifies in its child.

    Only candidate rows are joined, never the whole genotype table. The other side has a row per
    child with its qualifying genes, at most as many as there are gene symbols.
    """
    candidate = F.coalesce(compound_candidate(), F.lit(False))
    pairs = compound_pairs(_gene_rows(g, genes, variant), child)
    sets = pairs.groupBy(F.col(child).alias("_child")).agg(F.collect_set("gene").alias("_pairs"))
    mine = g.filter(candidate)
    if isinstance(genes, str):
        mine = mine.withColumn("_lof_genes", F.col(genes))
    else:
        of_variant = genes.groupBy(F.col(variant).alias("_variant")).agg(F.collect_set("gene").alias("_lof_genes"))
        mine = mine.join(of_variant, F.col(variant) == F.col("_variant"), "left").drop("_variant")
    hit = F.coalesce(F.arrays_overlap("_lof_genes", "_pairs"), F.lit(False))
    marked = mine.join(sets, F.col(child) == F.col("_child"), "left").withColumn("_compound", hit).drop("_child", "_pairs", "_lof_genes")
    return g.filter(~candidate).withColumn("_compound", F.lit(False)).unionByName(marked)


def tag_modes(g: DataFrame, genes: DataFrame | str | None = None, assembly: str = "hg19", strict: bool = False,
              variant: str = "variant_key", child: str = "Sample_ID", lof: str = "lof") -> DataFrame:
    """Add ``mendelian_diseases``: all modes of each row in one pass; tagging twice changes nothing.

    Compound heterozygosity is decided per row: one of the row's genes must qualify in its child,
    whether the genes come as an array column or as a table (variant, gene). ``lof`` names the
    boolean column that says whether the row's variant is loss-of-function.
    """
    columns, tests = g.columns, row_modes(assembly, strict, lof)
    if genes is not None:
        g = _mark_compound(g, genes, variant, child)
        tests["compound_heterozygous"] = F.col("_compound")
    found = F.array_compact(F.array(*[F.when(tests[m], F.lit(m)) for m in V.MODES if m in tests]))
    if "mendelian_diseases" in columns:
        found = F.array_union(F.coalesce("mendelian_diseases", F.array().cast("array<string>")), found)
    return g.select(*[F.col(f"`{c}`") for c in columns if c != "mendelian_diseases"], found.alias("mendelian_diseases"))


def mode_counts(tagged: DataFrame, variant: str = "variant_key", child: str = "Sample_ID") -> DataFrame:
    """Distinct (variant, child) per mode."""
    rows = tagged.select(variant, child, F.explode("mendelian_diseases").alias("mode")).distinct()
    return rows.groupBy("mode").agg(F.count(F.lit(1)).alias("samples"))


def mode_predicates(mode: str, path: str = "sample") -> list[Nested]:
    """The nested filter of a search by mode, on the genotype that carries the tag."""
    return [nested_term(path, "mendelian_diseases", mode, array=True)]


def mode_consequences(mode: str) -> list[Nested]:
    """With VEP, three modes also ask for a loss-of-function consequence, on any transcript of the document."""
    return [nested_terms("CSQ_nested", "Consequence", V.LOF_CONSEQUENCES, array=True)] if mode in V.LOF_MODES else []


def kindred(df: DataFrame, n: int, variant: str = "variant_key", family: str = "Family_ID") -> DataFrame:
    """Rows of variants matched in more than ``n`` families."""
    shared = (df.select(variant, family).distinct().groupBy(variant).agg(F.count(family).alias("_families"))
              .filter(F.col("_families") > n).select(variant))
    return df.join(shared, variant, "left_semi")


# --- ad-hoc trios ------------------------------------------------------------------------

def trio_genotypes(g: DataFrame, child: str, father: str, mother: str, keys: Sequence[str],
                   sample: str = "Sample_ID") -> DataFrame:
    """One row per variant with the three genotypes of named samples."""
    wanted = g.filter(F.col(sample).isin(child, father, mother)).groupBy(*keys)
    return wanted.agg(*[F.max(F.when(F.col(sample) == who, F.col("GT"))).alias(name) for name, who in
                        (("father_gt", father), ("mother_gt", mother), ("child_gt", child))])


def trio_query(g: DataFrame, child: str, father: str, mother: str, mode: str, keys: Sequence[str],
               sample: str = "Sample_ID") -> DataFrame:
    """Variants of one trio in a cohort without reference calls: an absent parent has none."""
    rows = trio_genotypes(g, child, father, mother, keys, sample)
    f, m, c = F.col("father_gt"), F.col("mother_gt"), F.col("child_gt")
    rules = {
        "recessive": c.isin(V.HOM_ALT) & f.isin(V.HET) & m.isin(V.HET),
        "dominant": c.isin(V.HET) & ((m.isin(V.HET) & f.isNull()) | (f.isin(V.HET) & m.isNull())),
        "denovo": c.isin(V.HET) & f.isNull() & m.isNull(),
    }
    return rows.filter(rules[mode])


def trio_compound_het(g: DataFrame, genes: DataFrame, child: str, father: str, mother: str,
                      keys: Sequence[str], sample: str = "Sample_ID") -> DataFrame:
    """Gene, variant and the trio's genotypes where one gene has variants from both parents."""
    rows = trio_genotypes(g, child, father, mother, keys, sample)
    f, m = F.col("father_gt"), F.col("mother_gt")
    maternal, paternal = m.isin(V.TRIO_HET) & f.isin(V.HOM_REF), f.isin(V.TRIO_HET) & m.isin(V.HOM_REF)
    hits = rows.filter(F.col("child_gt").isin(V.TRIO_HET) & (maternal | paternal)).join(genes.distinct(), list(keys))
    both = hits.groupBy("gene").agg(F.max(maternal).alias("_m"), F.max(paternal).alias("_f")).filter("_m and _f").select("gene")
    return hits.join(both, "gene", "left_semi").select("gene", *keys, "father_gt", "mother_gt", "child_gt")

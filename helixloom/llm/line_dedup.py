"""Line dedup by a log-template tree, in built-in functions only.

A line is cut into tokens at [\\x20\\x09-\\x0D]+; a token with a digit is a variable field, `<*>`. The tree has a fixed depth:
the number of tokens, then the leading `DEPTH` tokens lead to a leaf. Inside a leaf a token is constant where at least
`min_docs` documents have it at that place, and a variable field otherwise; a line whose tokens are constant to a share of
`similarity` or more takes that template, any other line is its own template. Templates that stand in `min_docs`
documents or more are dropped from all of them. Blank lines are neither counted nor dropped.

This is independent of the order of lines, unlike a tree grown line by line. Lines travel as two 64-bit hashes (leaf and
line); texts are looked at again only in leaves that hold several different lines and enough documents to recur.
Copies of a line merge before they are shuffled, so a line in a third of all documents costs as much as any other.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.llm.common import stored

DEPTH = 3
MIN_DOCS = 10
SIMILARITY = 0.5
FIELD = "<*>"
# What a line has unless its tokens are parted by single spaces.
ODD_SPACE = ("  ", "\t", "\x0b", "\x0c", "\r")


def even(line: Column) -> Column:
    """Tokens parted by one space."""
    odd = reduce(or_, [line.contains(x) for x in ODD_SPACE])
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))


def masked(line: Column) -> Column:
    """Tokens parted by one space, with `<*>` for those that hold a digit. `line` is `even`."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)).otherwise(line)


def _leaf(line: Column) -> Column:
    tokens = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return F.xxhash64(tokens, F.substring_index(line, " ", DEPTH))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _masked(text: Column) -> Column:
    """Masked lines of a text. A function of a list's members computes what it names anew at each place, so each step is a list of its own."""
    return F.transform(F.transform(_lines(text), even), masked)


def _key(line: Column) -> Column:
    """Leaf and hash of a line; null for a blank one."""
    return F.when(line != "", F.struct(_leaf(line).alias("leaf"), F.xxhash64(line).alias("line")))


def recurring(docs: DataFrame, keyed: DataFrame, min_docs: int, similarity: float) -> DataFrame:
    """(leaf, line) of the lines to drop. keyed: one row per document with the keys of its lines."""
    once = keyed.select("doc", "h", F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("k")).select("doc", "h", "k.*")
    counted = stored(once.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n")), "lines")
    alone = counted.filter(F.col("n") >= min_docs).select("leaf", "line")
    leaves = counted.groupBy("leaf").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    open_leaves = stored(leaves.filter((F.col("kinds") > 1) & (F.col("n") >= min_docs) & (F.col("least") < min_docs)).select("leaf"), "leaves")
    words = docs.select(F.explode(F.filter(_masked(F.col("text")), lambda x: x != "")).alias("said"))
    words = words.withColumn("leaf", _leaf(F.col("said"))).join(open_leaves, "leaf", "left_semi")
    said = words.groupBy("leaf", F.xxhash64("said").alias("line")).agg(F.first("said").alias("said"))
    tokens = stored(said.join(counted, ["leaf", "line"]).select("leaf", "line", "n", F.posexplode(F.split("said", " ")).alias("place", "token")), "tokens")
    support = stored(tokens.groupBy("leaf", "place", "token").agg(F.sum("n").alias("held")), "support")
    shown = tokens.join(support, ["leaf", "place", "token"]).withColumn("constant", (F.col("held") >= min_docs) & (F.col("token") != FIELD))
    template = shown.groupBy("leaf", "line").agg(
        F.avg(F.col("constant").cast("int")).alias("alike"),
        F.array_sort(F.collect_list(F.struct("place", F.when(F.col("constant"), F.col("token")).otherwise(FIELD).alias("token")))).alias("t"),
        F.max(~F.col("constant") & (F.col("token") != FIELD)).alias("general"))
    general = template.filter(F.col("general") & (F.col("alike") >= similarity)).select("leaf", "line", F.xxhash64("t.token").alias("template"))
    # Documents of a template: each counts once, whatever number of its lines fit.
    general = stored(general, "templates")
    fits = once.join(general, ["leaf", "line"]).select("leaf", "template", "doc", "h").distinct()
    often = fits.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)
    return stored(alone.unionByName(general.join(often, ["leaf", "template"]).select("leaf", "line")).distinct(), "recurring")


def _places(docs: DataFrame, min_docs: int, similarity: float) -> DataFrame:
    """(doc, h, gone): places of the lines to drop, per document that has any."""
    keyed = stored(docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("h"), F.transform(
        _masked(F.col("text")), _key).alias("keys")), "keys")
    dropped = recurring(docs, keyed, min_docs, similarity)
    every = keyed.dropDuplicates(["doc", "h"]).select("doc", "h", F.posexplode("keys").alias("place", "k")).filter("k is not null")
    return every.select("doc", "h", "place", "k.*").join(dropped, ["leaf", "line"]).groupBy("doc", "h").agg(F.collect_set("place").alias("gone"))


def _cut(docs: DataFrame, min_docs: int, similarity: float, *columns: tuple[str, Column]) -> DataFrame:
    gone = _places(docs, min_docs, similarity)
    rows = docs.select(F.xxhash64("text").alias("k"), F.col("doc_id").alias("d"), *[c.alias(n) for n, c in columns])
    met = rows.join(gone, F.col("d").eqNullSafe(F.col("doc")) & (F.col("k") == F.col("h")), "left")
    none = F.array().cast("array<int>")
    gone_here = F.coalesce("gone", none)
    # Places that stay, through a hash set: linear in the lines however many go.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i)))
    return met.withColumn("n_dropped", F.size(gone_here).cast("long")).withColumn("kept", F.array_join(kept, "\n"))


def annotate(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of the kept lines joined by line ends); one row per input row.

    Null text is one blank line. Every row is a document of its own, repeated rows too. Other columns are not read.
    """
    cut = _cut(docs, min_docs, similarity, ("doc_id", F.col("doc_id")), ("lines", _lines(F.col("text"))))
    return cut.select("doc_id", F.size("lines").cast("long").alias("n_lines"), "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def deduplicate(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """All rows and columns of the input; `text` is without the dropped lines."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    cut = _cut(docs, min_docs, similarity, ("row", row), ("lines", _lines(F.col("text"))))
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text"))
    return cut.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])

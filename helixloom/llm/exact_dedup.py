"""Exact dedup: two passes over a Bloom filter, then only rows that may repeat are shuffled.

Texts are equal when they are identical after deleting every character of [\\x20\\x09-\\x0D]; null counts as empty.
Of equal texts the row with the most code points stays, then the smallest doc_id (a null doc_id comes last).

Pass one hashes each text to two cells of a Bloom filter and counts hits per cell (partial sums before the shuffle);
cells hit twice or more form the filter of possibly repeated texts. Pass two tests each row: a row with a cell that was
hit once is unique and passes straight through; all others, a few false positives among them, meet by digest. A repeated
text always has all its cells hit twice, so none is missed.

The filter is broadcast. It takes 16 bits a row up to `MAX_BITS` (64 MB); a larger table gets the same result with more
false positives, in the limit a plain shuffle of digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixloom.llm.common import WHITE, lean, packed, stored, texts, unpacked

BITS_PER_ROW = 16
MAX_BITS = 1 << 29
SEGMENT = 1 << 13


@F.arrow_udf(T.StringType())
def _digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """SHA-256 of the text without white space."""
    for column in lean(batches):
        yield pa.array([hashlib.sha256(t.translate(None, WHITE)).hexdigest() for t in texts(column)], pa.string())
        column = None


# Not deterministic in name only, so that the plan never computes it twice for one row.
text_digest = _digest.asNondeterministic()


def _cells(digest: Column, bits: int) -> list[Column]:
    h = F.xxhash64(digest)
    return [F.pmod(h, F.lit(bits)), F.pmod(F.xxhash64(digest, F.lit(1)), F.lit(bits))]


def repeat_filter(digests: DataFrame, rows: int) -> np.ndarray:
    """Packed bits of the cells that two or more rows of `digests` (one column, digest) hit."""
    bits = min(MAX_BITS, 1 << max(16, (BITS_PER_ROW * max(rows, 1) - 1).bit_length()))
    hit = digests.select(F.explode(F.array(*_cells(F.col("digest"), bits))).alias("cell"))
    twice = hit.groupBy("cell").count().filter("count > 1")
    # One row per segment of the filter: at most SEGMENT small numbers each.
    by_segment = twice.groupBy(F.floor(F.col("cell") / SEGMENT).alias("segment")).agg(
        F.collect_list((F.col("cell") % SEGMENT).cast("short")).alias("cells"))
    out = np.zeros(bits // 8, np.uint8)
    width = SEGMENT // 8
    for segment, cells in by_segment.toLocalIterator():
        flags = np.zeros(SEGMENT, bool)
        flags[cells] = True
        out[segment * width:(segment + 1) * width] = np.packbits(flags, bitorder="little")
    return out


def maybe_repeated(spark, bloom: np.ndarray, digest: Column) -> Column:
    """True where both cells of a digest are in the filter."""
    sent = spark.sparkContext.broadcast(bloom)

    @F.arrow_udf("boolean")
    def in_filter(a: pa.Array, b: pa.Array) -> pa.Array:
        table = sent.value
        hits = [(table[c >> 3] >> (c & 7)) & 1 for c in (a.to_numpy(False), b.to_numpy(False))]
        return pa.array((hits[0] & hits[1]).astype(bool))

    return in_filter.asNondeterministic()(*_cells(digest, len(bloom) * 8))


def _judged(spark, bloom: np.ndarray, text: Column) -> Column:
    """Digest, and whether both of its cells are in the filter, by one function: two in a row would take two Python workers a task."""
    sent = spark.sparkContext.broadcast(bloom)

    @F.arrow_udf("struct<digest: string, maybe: boolean>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = sent.value
        last = len(table) * 8 - 1  # the number of cells is a power of two
        for column in lean(batches):
            digests, maybe = [], []
            for t in texts(column):
                digests.append(hashlib.sha256(t.translate(None, WHITE)).hexdigest())
                # Spark's xxhash64 of the digest, and of the digest and the integer 1, as in _cells.
                h = xxhash.xxh64_intdigest(digests[-1], 42)
                cells = h & last, xxhash.xxh64_intdigest(b"\x01\0\0\0", h) & last
                maybe.append(all(int(table[c >> 3]) >> (c & 7) & 1 for c in cells))
            yield pa.StructArray.from_arrays([pa.array(digests, pa.string()), pa.array(maybe, pa.bool_())], ["digest", "maybe"])
            column = None

    return of.asNondeterministic()(text)


def annotate(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows that repeat doc_id and text are one group as well and exactly one of them is kept. An empty table gives no rows.
    Other columns of the input are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = stored(docs.select("doc_id", text_digest(text).alias("digest"), F.char_length(text).cast("long").alias("size")), "digests")
    bloom = repeat_filter(keys.select("digest"), keys.count())
    marked = keys.withColumn("maybe", maybe_repeated(spark, bloom, F.col("digest")))
    single = marked.filter("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))
    # Copies are counted before they meet, so a text with a third of all rows is a few rows per task.
    alike = marked.filter("maybe").groupBy("digest", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))
    rank = F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    # Stored, so that the join below is one of plain scans and a hot digest can be split.
    groups = stored(alike.groupBy("digest").agg(F.min(rank).alias("best"), F.sum("copies").alias("group_size")), "groups")
    many = alike.join(groups, "digest").withColumn("winner", rank.eqNullSafe(F.col("best"))).select(
        "doc_id", F.col("best.id").alias("keep_id"), F.col("group_size"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth"), "winner", "digest")
    return single.unionByName(many.select(
        "doc_id", "keep_id", "group_size", (F.col("winner") & (F.col("nth") == 1)).alias("kept"), F.col("digest").alias("text_sha256")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all columns of the input."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    digests = docs.select(text_digest(text).alias("digest"))
    bloom = repeat_filter(digests, docs.count())
    rows = packed(docs, ("judged", _judged(spark, bloom, text)), ("size", F.char_length(text)), ("doc_id", F.col("doc_id")))
    rows = rows.select("row", "size", "doc_id", "judged.digest", "judged.maybe")
    # Rows that tie in length and doc_id differ in white space or other columns only; their JSON decides.
    rank = F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.to_json("row").alias("rest"))
    many = rows.filter("maybe").withColumn("rank", rank).groupBy("digest").agg(F.min_by("row", "rank").alias("row"))
    return unpacked(rows.filter("not maybe").select("row").unionByName(many.select("row")))

"""Benchmark decontamination: Wu-Manber search for windows of benchmark items in documents.

Texts are lower-cased (A-Z) and cut into words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. A pattern is `window` consecutive words of an
item; an item of fewer words, but not none, is one pattern. Words are the symbols of the search. For each pattern
length there is a table of blocks (up to three words) with the shift that is safe when a block ends at the text position;
a block that ends some pattern has shift zero and a bucket, where the words themselves are compared.

The benchmark is a stated query set. It goes to the executors in blocks of at most `BLOCK_WORDS` pattern words; documents
are read once per block and never shuffled while there is one block.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.llm.common import lean, packed, texts, unpacked

WINDOW = 10
BLOCK_WORDS = 2_000_000
# Word characters stay, A-Z become a-z, everything else parts words.
_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def build_tables(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> dict:
    """Plain search tables of some items: word numbers, and per pattern length the shifts and buckets."""
    vocab: dict[bytes, int] = {}
    patterns: dict[int, dict[bytes, set]] = {}
    numbered = []
    for name, text in items:
        ids = array("i", [vocab.setdefault(w, len(vocab) + 1) for w in words_of(text)])
        if ids:
            numbered.append((name, ids))
    for name, ids in numbered:
        m = min(window, len(ids))
        for at in range(len(ids) - m + 1):
            patterns.setdefault(m, {}).setdefault(ids[at:at + m].tobytes(), set()).add(name)
    base, searches = len(vocab) + 1, []
    for m, found in sorted(patterns.items()):
        size = min(3, m)
        shift: dict[int, int] = {}
        buckets: dict[int, dict[bytes, tuple]] = {}
        for raw, names in found.items():
            ids = array("i")
            ids.frombytes(raw)
            for stop in range(size, m + 1):
                block = 0
                for w in ids[stop - size:stop]:
                    block = block * base + w
                shift[block] = min(shift.get(block, m), m - stop)
            buckets.setdefault(block, {})[raw] = tuple(sorted(n for n in names if n is not None))
        searches.append((m, size, m - size + 1, shift, buckets))
    return {"vocab": vocab, "base": base, "searches": searches}


def search(tables: dict, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged word spans inside any occurrence, and the names of the items with occurring windows."""
    ids = array("i", map(tables["vocab"].get, words, repeat(0)))
    n, base = len(ids), tables["base"]
    spans, names = [], set()
    for m, size, far, shift, buckets in tables["searches"]:
        end, get = m, shift.get
        while end <= n:
            if size == 3:
                block = (ids[end - 3] * base + ids[end - 2]) * base + ids[end - 1]
            else:
                block = ids[end - 1] if size == 1 else ids[end - 2] * base + ids[end - 1]
            step = get(block, far)
            if step:
                end += step
                continue
            hit = buckets[block].get(ids[end - m:end].tobytes())
            if hit is not None:
                names.update(hit)
                spans.append((end - m, end))
            end += 1
    merged: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
        else:
            merged.append((start, stop))
    return merged, names


def _found(spark, tables: dict):
    sent = spark.sparkContext.broadcast(tables)

    @F.arrow_udf(FOUND_TYPE)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in lean(batches):
            n, hits, items = [], [], []
            for text in texts(column):
                words = words_of(text)
                spans, names = search(sent.value, words)
                n.append(len(words))
                hits.append([{"start": a, "stop": b} for a, b in spans])
                items.append(sorted(names))
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
                ["n_words", "hits", "items"])
            column = n = hits = items = None

    return of.asNondeterministic()


FOUND_TYPE = "struct<n_words: bigint, hits: array<struct<start: int, stop: int>>, items: array<string>>"


def _blocks(benchmark: DataFrame, window: int, budget: int) -> Iterator[dict]:
    """Search tables of one block of items after the other; the driver holds one at a time."""
    items, weight, any_yet = [], 0, False
    for name, text in benchmark.select(F.col("item_id").cast("string"), F.coalesce(F.col("text"), F.lit(""))).toLocalIterator():
        raw = text.encode()
        items.append((name, raw))
        weight += window * (raw.count(b" ") + raw.count(b"\n") + 1)
        if weight > budget:
            yield build_tables(items, window)
            items, weight, any_yet = [], 0, True
    if items or not any_yet:
        yield build_tables(items, window)


def _sets(spans: F.Column) -> F.Column:
    """Merge sorted spans that touch or overlap."""
    kind = "array<struct<start: int, stop: int>>"

    def add(done: F.Column, s: F.Column) -> F.Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))).cast(kind)
        return F.when((F.size(done) > 0) & (last["stop"] >= s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), longer)).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, hits (merged word spans), items (sorted distinct item ids as strings), one row per input row.

    Null text has no words. Items without words match nothing; an item with a null id marks words but is not listed.
    Repeated items count once. Other columns are not read.
    """
    spark = docs.sparkSession
    runs = [_found(spark, t) for t in _blocks(benchmark, window, block_words)]
    if len(runs) == 1:
        return docs.select("doc_id", runs[0](F.col("text")).alias("m")).select("doc_id", "m.*")
    # Hits of all blocks meet by row; rows equal in id and text are told apart by their number.
    parts = [docs.select("doc_id", F.xxhash64("text").alias("h"), f(F.col("text")).alias("m")).select("doc_id", "h", "m.*") for f in runs]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    met = every.groupBy("doc_id", "h").agg(
        F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count(F.lit(1)) / len(runs)).cast("int").alias("copies"))
    return met.select("doc_id", "n_words", _sets(F.col("hits")).alias("hits"), "items", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")).drop("nth")


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = matches(docs, benchmark, window, block_words)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows without any occurrence, with all columns of the input."""
    spark = docs.sparkSession
    rows = packed(docs, ("text", F.col("text")))
    for tables in _blocks(benchmark, window, block_words):
        rows = rows.withColumn("m", _found(spark, tables)(F.col("text"))).filter(F.size("m.hits") == 0).drop("m")
    return unpacked(rows)

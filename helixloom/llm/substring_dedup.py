"""Substring dedup: relative Lempel-Ziv parsing of every document against blocks of all documents before it.

Words are [^\\x20\\x09-\\x0D]+, unchanged. A window is `window` consecutive words; it repeats when its words also start in a
document with a smaller doc_id. Every word that a repeated window covers is a duplicate.

Blocks. Each window is anchored at the leftmost of its `gram`-word grams with the least hash, so equal windows have equal
anchors wherever they stand. A block is a run of windows with one anchor; its words are the windows together. All documents
are cut into such blocks and all blocks are indexed by anchor and content, so the index is the reference, dealt out by content.

Factors. A document is parsed against the index block by block: a block whose whole content stands in an earlier document is
copied as it is. Only where blocks with one anchor differ (the boundaries of a copied passage, or an edit in it) is the
factor's end looked for word by word: the windows of each such content are compared once, in the document where it stands
first. Copied blocks and windows that touch make a factor; each is at least one window long, and becomes a duplicate span.

Only anchors that stand in two documents or more go on after the first, narrow, aggregation. Nothing is paired within a group: a
block or window keeps its smallest doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.llm.common import packed, stored, texts, unpacked

WINDOW = 50
GRAM = 12
# Windows handled at a time, which bounds memory for very long texts.
PIECE = 1 << 17
NO_ID = (1 << 63) - 1
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class _Rolling:
    """Hashes of word runs from one pass over the words: prefix sums over powers of an odd base, modulo 2^64."""

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(base))]), dtype=np.uint64)
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(base, -1, 1 << 64)))]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(words ^ np.uint64(base)) * power[:-1], dtype=np.uint64)])

    def run(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def blocks(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, content hash, first window, number of windows) of a document's blocks."""
    gram = min(gram, window)
    grams = window - gram + 1
    for at in range(0, len(hashes) - window + 1, PIECE):
        part = hashes[at:at + PIECE + window - 1]
        count = len(part) - window + 1
        roll = _Rolling(part, _BASES[0])
        first = np.arange(len(part) - gram + 1)
        g = roll.run(first, first + gram)
        anchor = np.lib.stride_tricks.sliding_window_view(g, grams).argmin(axis=1) + np.arange(count)
        start = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
        stop = np.append(start[1:], count)
        content = roll.run(start, stop + window - 1)
        yield g[anchor[start]], content, start + at, stop - start


def _block_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(False), batch.column(1).to_numpy(False)
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            held = 0
            for i, text in enumerate(texts(batch.column(2))):
                for anchor, content, start, count in blocks(word_hashes(text), window, gram):
                    n = len(anchor)
                    for column, values in zip(out, (np.full(n, ids[i]), np.full(n, keys[i]), anchor.view(np.int64), content.view(np.int64), start, count)):
                        column.append(values)
                    held += n
                if held > 100_000:
                    yield _batch(out, held)
                    out, held = [[] for _ in range(6)], 0
            if held:
                yield _batch(out, held)

    return run


def _batch(out: list[list[np.ndarray]], held: int) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in out]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols[:4]] + [pa.array(c.astype(np.int32)) for c in cols[4:]],
                                      ["doc", "h", "anchor", "content", "start", "count"])


def _window_rows(window: int):
    """Hashes of the windows asked for: (doc, h, text, asked) in, (w1, w2, doc, h, start) out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(False), batch.column(1).to_numpy(False)
            asked = batch.column(3)
            for i, text in enumerate(texts(batch.column(2))):
                hashes = word_hashes(text)
                wanted = np.array(asked[i].values.to_numpy(), np.int64)
                starts = np.concatenate([np.arange(p >> 16, (p >> 16) + (p & 0xFFFF)) for p in wanted.tolist()])
                starts.sort()
                for piece in np.split(starts, np.flatnonzero(starts[1:] // PIECE != starts[:-1] // PIECE) + 1):
                    base = int(piece[0])
                    part = hashes[base:int(piece[-1]) + window]
                    at = piece - base
                    w = [_Rolling(part, b).run(at, at + window).view(np.int64) for b in _BASES]
                    n = len(piece)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(w[0]), pa.array(w[1]), pa.array(np.full(n, ids[i])), pa.array(np.full(n, keys[i])), pa.array(piece.astype(np.int32))],
                        ["w1", "w2", "doc", "h", "start"])

    return run


def spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, h, spans): per document with duplicates, packed word spans start << 32 | stop, neither sorted nor merged.

    `doc` is the doc_id (a null one counts as greater than all), `h` a hash of the text, so rows that share a doc_id are
    told apart; rows equal in both have equal spans.
    """
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc"), F.xxhash64("text").alias("h"), "text")
    cut = keyed.mapInArrow(_block_rows(window, gram), "doc long, h long, anchor long, content long, start int, count int")
    # What rows join below is stored first: a join of plain scans can be split where an anchor is hot.
    shared = stored(cut.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("anchor"), "anchors")
    repeated = stored(cut.join(shared, "anchor"), "blocks")
    content = stored(repeated.groupBy("anchor", "content").agg(F.min("doc").alias("source")), "contents")
    placed = repeated.join(content, ["anchor", "content"])
    # Whole blocks: every document after the first one that holds the content.
    copied = placed.filter("doc > source").select("doc", "h", "start", (F.col("start") + F.col("count") + (window - 1)).alias("stop"))
    # Where contents with one anchor differ, windows are compared, those of a content in its first document only.
    differ = stored(content.groupBy("anchor").agg(F.min("content").alias("a"), F.max("content").alias("b")).filter("a < b").select("anchor"), "differ")
    edge = placed.filter("doc = source").join(differ, "anchor")
    asked = edge.groupBy("doc", "h").agg(F.collect_set(F.shiftleft(F.col("start").cast("long"), 16).bitwiseOR(F.col("count").cast("long"))).alias("asked"))
    rows = keyed.join(asked, ["doc", "h"]).dropDuplicates(["doc", "h"]).select("doc", "h", "text", "asked")
    seen = stored(rows.mapInArrow(_window_rows(window), "w1 long, w2 long, doc long, h long, start int"), "windows")
    least = stored(seen.groupBy("w1", "w2").agg(F.min("doc").alias("source"), F.max("doc").alias("last")).filter("source < last").drop("last"), "sources")
    found = seen.join(least, ["w1", "w2"]).filter("doc > source").select("doc", "h", "start", (F.col("start") + window).alias("stop"))
    every = copied.unionByName(found)
    packed_span = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("stop").cast("long"))
    return every.groupBy("doc", "h").agg(F.collect_list(packed_span).alias("spans"))


def merged(packed_spans: np.ndarray | None) -> list[tuple[int, int]]:
    """Factors: sorted spans, joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    if packed_spans is None or not len(packed_spans):
        return out
    p = np.sort(packed_spans)
    start, stop = p >> 32, np.maximum.accumulate(p & 0xFFFFFFFF)
    cuts = np.flatnonzero(start[1:] > stop[:-1]) + 1
    return list(zip(start[np.append([0], cuts)].tolist(), stop[np.append(cuts - 1, len(p) - 1)].tolist()))


def _rest(text: bytes, factors: list[tuple[int, int]]) -> tuple[int, int, list[bytes]]:
    words = text.split()
    n = len(words)
    for start, stop in reversed(factors):
        del words[start:stop]
    return n, n - len(words), words


def _parsed(docs_text: Column, column: Column, keep_text: bool) -> Column:
    shape = "n_words: bigint, n_removed: bigint, kept_sha256: string, factors: array<struct<start: int, stop: int>>" + (", kept: string" if keep_text else "")

    @F.arrow_udf(f"struct<{shape}>")
    def of(text: pa.Array, found: pa.Array) -> pa.Array:
        n, gone, sha, factors, kept = [], [], [], [], []
        for i, raw in enumerate(texts(text)):
            spans_of = merged(found[i].values.to_numpy() if found[i].is_valid else None)
            all_words, removed, rest = _rest(raw, spans_of)
            line = b" ".join(rest)
            n.append(all_words)
            gone.append(removed)
            sha.append(hashlib.sha256(line).hexdigest())
            factors.append([{"start": a, "stop": b} for a, b in spans_of])
            if keep_text:
                kept.append(line.decode())
        cols = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()),
                pa.array(factors, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]
        names = ["n_words", "n_removed", "kept_sha256", "factors"]
        return pa.StructArray.from_arrays(cols + [pa.array(kept, pa.string())] * keep_text, names + ["kept"] * keep_text)

    return of.asNondeterministic()(docs_text, column)


def _with_spans(docs: DataFrame, window: int, gram: int, *columns: tuple[str, Column]) -> DataFrame:
    found = spans(docs, window, gram)
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc"), F.xxhash64("text").alias("h"), *[c.alias(n) for n, c in columns])
    return rows.join(found, ["doc", "h"], "left")


def annotate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, factors (word spans removed); one row per input row.

    Null text has no words; a text shorter than a window keeps all its words. A null doc_id counts as greater than every
    other; rows that share a doc_id do not remove each other's words. Other columns are not read.
    """
    rows = _with_spans(docs, window, gram, ("doc_id", F.col("doc_id")), ("text", F.col("text")))
    return rows.select("doc_id", _parsed(F.col("text"), F.col("spans"), False).alias("p")).select("doc_id", "p.*")


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """All rows and columns of the input; `text` is replaced by the kept words where any were removed."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = _with_spans(docs, window, gram, ("row", row), ("text", F.col("text")))
    parsed = rows.select("row", "text", _parsed(F.col("text"), F.col("spans"), True).alias("p"))
    text = F.when(F.col("p.n_removed") > 0, F.col("p.kept")).otherwise(F.col("text"))
    return parsed.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])

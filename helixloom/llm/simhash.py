"""SimHash near-dedup: fingerprints linked at a small Hamming distance through BK-trees of shards.

A text is lower-cased (A-Z), cut into words [^\\x20\\x09-\\x0D]+ and into shingles of `shingle` words, repeats included (a
shorter text is one shingle). A bit of the 64-bit fingerprint is 1 if it is set in over half of the shingles' XXH64
hashes (seed 42); a text without words has fingerprint zero.

Equal fingerprints are one node, whatever their number of documents. A shard is the set of fingerprints that agree under a
mask of bits. Up to `EXACT` bits of radius the masks are radius + 1 blocks, so a pair within the radius meets in a shard for
certain. For a wider radius they are samples of bits, as many as find `RECALL` of the pairs `USUAL` bits apart.

In each shard a BK-tree (children keyed by their integer distance to the parent) is built and searched with all members at
once, following only edges within the radius of a query's distance. A shard of more than `SHARD` members becomes several
trees; each member queries those from its own on. Trees travel to where the shard's rows are and are not broadcast,
because the fingerprints of all documents have no size bound.

A shard gives a spanning set of links between its closest fingerprints, not all pairs. Components come from large-star and
small-star rounds over the links, each stored in the shared folder.

Where a similarity is asked for, nodes are distinct shingle sets and links from fingerprints are only a first pass: they are
confirmed on the sets, and join most near copies cheaply. A second pass is complete (`unmet`): of two sets similar enough, each
has a common shingle among its first few in any order of shingles (prefix filter), so sets of different components that
share one there are compared as well. Shingles that are common in a sample come last in that order; the sample steers cost,
not results.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.llm.common import give_back, lean, packed, pieces, released, stored, texts, unpacked
from helixloom.operators.sizing import broadcast_if, is_small

SHARD = 2048
EXACT = 3
# For a wider radius: bits that most near copies differ in at most, and the share of pairs at that distance to be found.
USUAL = 9
RECALL = 0.95
# Texts looked at for common shingles, and how many of those are told apart.
SAMPLE = 10_000
COMMON = 50_000


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, in runs of bounded length."""
    words = text.lower().split()
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        if words:
            yield np.array([digest(line, 42)], np.uint64)
        return
    lens = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lens + 1)[:-1]))
    ends = starts + lens
    n = len(words) - shingle + 1
    for at in range(0, n, 51_000):  # 200 runs of 255
        to = min(n, at + 51_000)
        yield np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[at:to].tolist(), ends[at + shingle - 1:to + shingle - 1].tolist())), np.uint64, to - at)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    return majority(shingle_hashes(text, shingle))


def majority(runs: Iterable[np.ndarray]) -> int:
    """Bits set in over half of the hashes."""
    n, counts = 0, np.zeros(64, np.int64)
    for h in runs:
        n += len(h)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        runs = -(-len(bits) // 255)  # sums of 255 bits fit a byte
        bits = np.concatenate([bits, np.zeros((runs * 255 - len(bits), 64), np.uint8)]).reshape(runs, 255, 64)
        counts += bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > n))


def fingerprints(text: F.Column, shingle: int = 3) -> F.Column:
    """Fingerprints as signed 64-bit numbers."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in lean(batches):
            prints = np.fromiter((fingerprint(t, shingle) for t in texts(column)), np.uint64, len(column))
            yield pa.array(prints.view(np.int64))
            column = None

    return of(text)


def shingle_sets(text: F.Column, shingle: int) -> F.Column:
    """Fingerprint, distinct shingle hashes in order of size, and a digest of these."""

    @F.arrow_udf("struct<print: bigint, node: bigint, set: array<bigint>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in pieces(lean(batches)):
            prints, nodes, sets = [], [], []
            for t in texts(column):
                runs = list(shingle_hashes(t, shingle))
                prints.append(majority(runs))
                sets.append(np.unique(np.concatenate([*runs, np.zeros(0, np.uint64)])).view(np.int64))
                nodes.append(xxhash.xxh64_intdigest(sets[-1].tobytes(), 42))
            yield pa.StructArray.from_arrays([
                pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(np.array(nodes, np.uint64).view(np.int64)),
                pa.array(sets, pa.list_(pa.int64()))], ["print", "node", "set"])
            column = prints = nodes = sets = None

    return of.asNondeterministic()(text)


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.children: list[dict[int, int]] = [{} for _ in prints]
        values = prints.tolist()
        for i in range(1, len(values)):
            at = 0
            while True:
                edge = (values[i] ^ values[at]).bit_count()
                if edge == 0 or edge not in self.children[at]:
                    break
                at = self.children[at][edge]
            if edge:
                self.children[at][edge] = i

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, positions of the queries within the radius of it), for nodes with any."""
        todo = [(0, np.arange(len(queries)))] if len(self.prints) and len(queries) else []
        while todo:
            node, active = todo.pop()
            far = np.bitwise_count(queries[active] ^ self.prints[node])
            near = active[far <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node].items():
                follow = active[(far <= edge + radius) & (far + radius >= edge)]
                if len(follow):
                    todo.append((child, follow))


def _spanning(n: int, found: list[tuple[np.ndarray, ...]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of n nodes, and the (x, y) pairs that make them: of pairs (x, y, distance) the closest first."""
    labels, chosen = np.arange(n), []
    if not found:
        return labels, np.zeros((0, 2), np.int64)
    x, y, far = (np.concatenate(c) for c in zip(*found))
    for level in range(radius + 1):
        at = np.flatnonzero(far == level)
        at = at[labels[x[at]] != labels[y[at]]]
        if not len(at):
            continue
        _, first = np.unique(labels[x[at]] * n + labels[y[at]], return_index=True)
        root: dict[int, int] = {}

        def top(i: int) -> int:
            while root.get(i, i) != i:
                i = root[i]
            return i

        for k in at[first].tolist():
            a, b = top(int(labels[x[k]])), top(int(labels[y[k]]))
            if a != b:
                root[max(a, b)] = min(a, b)
                chosen.append((x[k], y[k]))
        moved = np.arange(n)
        for i in root:
            moved[i] = top(i)
        labels = moved[labels]
    return labels, np.array(chosen, np.int64).reshape(-1, 2)


def _tree_links(prints: np.ndarray, radius: int) -> tuple[BKTree, np.ndarray, np.ndarray]:
    tree = BKTree(prints)
    found = [(near, np.full(len(near), node), np.bitwise_count(prints[near] ^ prints[node])) for node, near in tree.search(prints, radius)]
    return tree, *_spanning(len(prints), found, radius)


def _links(radius: int):
    """Rows (block, key, part, guest, print), sorted so that a tree's own members come before its guests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own, tree, labels, out = None, [], None, None, []

        def grown() -> None:
            nonlocal tree, labels
            prints = np.concatenate(own).view(np.uint64)
            tree, labels, pairs = _tree_links(prints, radius)
            out.append((prints[pairs[:, 0]], prints[pairs[:, 1]]))

        def flushed():
            a = np.concatenate([x for x, _ in out] or [np.zeros(0, np.uint64)]).view(np.int64)
            b = np.concatenate([x for _, x in out] or [np.zeros(0, np.uint64)]).view(np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            cols = [c.to_numpy(False) for c in batch.columns]
            if not len(batch):
                continue
            key = np.stack([cols[0].astype(np.int64), cols[1], cols[2].astype(np.int64)], axis=1)
            guest, prints = cols[3], cols[4]
            cuts = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if group != tuple(key[a]):
                    if own and tree is None:
                        grown()
                    group, own, tree = tuple(key[a]), [], None
                split = a + int(np.count_nonzero(~guest[a:b]))
                if split > a:
                    own.append(prints[a:split])
                if split < b and own:
                    if tree is None:
                        grown()
                    queries = prints[split:b].view(np.uint64)
                    # One link, the closest, from a guest to each linked component of the tree.
                    best: dict[tuple[int, int], tuple[int, int]] = {}
                    for node, near in tree.search(queries, radius):
                        root = int(labels[node])
                        for q, far in zip(near.tolist(), np.bitwise_count(queries[near] ^ tree.prints[node]).tolist()):
                            best[q, root] = min(best.get((q, root), (65, 0)), (far, node))
                    if best:
                        out.append((queries[[q for q, _ in best]], tree.prints[[node for _, node in best.values()]]))
            if out:
                yield flushed()
        if own and tree is None:
            grown()
            yield flushed()
        tree, labels = None, None
        own.clear()
        give_back()

    return run


def masks(radius: int, prints: int) -> list[int]:
    """Masks of bits under which pairs within the radius are looked for.

    Beyond `EXACT` they grow with the logarithm of the number of fingerprints, which keeps shards small, and there are as many
    as it takes for the same share of pairs at any size.
    """
    if radius <= EXACT:
        width = -(-64 // (radius + 1))
        return [((1 << min(width, 64 - at)) - 1) << at for at in range(0, 64, width)]
    size = min(40, max(14, prints.bit_length() - 3))
    miss = 1 - math.comb(64 - USUAL, size) / math.comb(64, size)
    rng = random.Random(64)
    return [sum(1 << b for b in rng.sample(range(64), size)) for _ in range(math.ceil(math.log(1 - RECALL) / math.log(miss)))]


def links(prints: DataFrame, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column print): closest pairs first, spanning what each shard links."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius, prints.count())]
    keyed = [F.struct(F.lit(i).alias("block"), F.col("print").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)]
    members = prints.select("print", F.explode(F.array(*keyed)).alias("k")).select("k.block", "k.key", "print")
    sizes = members.groupBy("block", "key").count().filter("count > 1").withColumn("parts", F.ceil(F.col("count") / shard).cast("int")).drop("count")
    met = members.join(sizes, ["block", "key"]).withColumn("own", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
    asked = met.withColumn("part", F.explode(F.sequence(F.col("own"), F.col("parts") - 1)))
    asked = asked.select("block", "key", "part", (F.col("part") != F.col("own")).alias("guest"), "print")
    return (asked.repartition("block", "key", "part").sortWithinPartitions("block", "key", "part", "guest")
            .mapInArrow(_links(radius), "a long, b long"))


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, bits): whether an odd number of a set's shingles falls on each of 2n to 4n places, a power of two, in 64-bit words."""
    for batch in batches:
        for start in range(0, len(batch), 256):
            part = batch.slice(start, 256)
            flat, sizes = part.column(1).flatten().to_numpy(False).view(np.uint64), part.column(1).value_lengths().to_numpy(False).astype(np.int64)
            words, ends = [np.zeros(0, np.int64)], np.cumsum(sizes)
            for a, b in zip((ends - sizes).tolist(), ends.tolist()):
                places = 1 << max(6, (2 * (b - a) - 1).bit_length())
                odd = np.bincount((flat[a:b] & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
                words.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
            offsets = np.cumsum([0, *map(len, words[1:])]).astype(np.int32)
            bits = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(words)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes.astype(np.int32)), bits], ["node", "n", "bits"])
        give_back()


def _hopeful(pairs: DataFrame, keys: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets can have the similarity, by an upper bound of their overlap; no pair that has it is left out.

    Places that differ between two parity bitmaps are at most the shingles that only one set holds. The longer bitmap is folded
    on the length of the shorter one, which keeps that true.
    """
    marks = stored(keys.mapInArrow(_parities, "node long, n int, bits array<long>"), "parities")
    a, b = (marks.select(F.col("node").alias(k), F.col("n").alias(f"{k}n"), F.col("bits").alias(f"{k}w")) for k in "ab")
    both = pairs.join(a, "a").join(b, "b")
    both = both.filter(F.least("an", "bn") >= similarity * F.greatest("an", "bn") - 1e-9)
    short = F.least(F.size("aw"), F.size("bw"))

    def folded(w: str) -> F.Column:
        return F.when(F.size(w) == short, F.col(w)).otherwise(
            F.zip_with(F.slice(w, F.lit(1), short), F.slice(w, short + 1, short), lambda x, y: x.bitwiseXOR(y)))

    # Sizes within a factor of 0.5 have lengths within a factor of two; other pairs are left to the exact check.
    far = F.aggregate(F.zip_with(folded("aw"), folded("bw"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    apart = F.when(F.greatest(F.size("aw"), F.size("bw")) <= 2 * short, far).otherwise(0)
    # A similarity s of sets of n and m in all leaves at most (n + m)(1 - s)/(1 + s) shingles that only one set holds.
    close = apart <= (F.col("an") + F.col("bn")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    out = stored(both.filter(close).select("a", "b"), "hopeful")
    del a, b, both
    released(marks)
    return out


def confirmed(pairs: DataFrame, keys: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes with a Jaccard similarity of shingle sets of at least `similarity`, stored. keys: node, set.

    Bitmaps a few per cent as long as the sets go with all pairs, whole sets only with those the bitmaps leave open.
    """
    def of(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
        return ends, keys.select("node", "set").join(broadcast_if(is_small(ends), ends), "node", "left_semi").dropDuplicates(["node"])

    pairs = stored(pairs.distinct(), "pairs")
    ends, sets = of(pairs)
    close = _hopeful(pairs, sets, similarity)
    del sets
    released(pairs, ends)
    ends, sets = of(close)
    sets = stored(sets, "sets")
    a, b = (sets.select(F.col("node").alias(n), F.col("set").alias(k)) for n, k in (("a", "x"), ("b", "y")))
    both = close.join(a, "a").join(b, "b").withColumn("n", F.size(F.array_intersect("x", "y")))
    alike = stored(both.filter(F.col("n") / (F.size("x") + F.size("y") - F.col("n")) >= similarity).select("a", "b"), "confirmed")
    del a, b, both
    released(close, ends, sets)
    return alike


def _first_pass(keys: DataFrame, radius: int) -> DataFrame:
    """Stored pairs of nodes by fingerprint: one node of each linked fingerprint, and that one with all others of its fingerprint."""
    named = stored(keys.groupBy("print", "node").agg(F.count(F.lit(1)).alias("n")), "named")
    ones = stored(named.groupBy("print").agg(F.min("node").alias("one")), "ones")
    linked = stored(links(ones.select("print"), radius).distinct(), "near")
    a, b = (ones.select(F.col("print").alias(p), F.col("one").alias(n)) for p, n in (("a", "x"), ("b", "y")))
    far = linked.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    same = named.join(ones, "print").filter("node <> one").select(F.col("one").alias("a"), F.col("node").alias("b"))
    pairs = stored(far.unionByName(same), "first-pass")
    del a, b, far, same
    released(named, ones, linked)
    return pairs


def _prefixes(keys: DataFrame, similarity: float) -> DataFrame:
    """(node, n, at, token): the first shingles of a set of n, rare ones before common ones, as many as leave less than `similarity` of it."""
    share = max(1, keys.count() // SAMPLE)
    seen = keys.filter(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).select(F.explode("set").alias("token")).groupBy("token").count()
    top = seen.filter("count > 1").orderBy(F.desc("count"), "token").limit(COMMON).toArrow()
    tokens, counts = (top[c].to_numpy().astype(np.int64) for c in ("token", "count"))
    order = np.argsort(tokens)
    sent = keys.sparkSession.sparkContext.broadcast((tokens[order], np.log2(counts[order]).astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, level = sent.value
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                flat, sizes = part.column(1).flatten().to_numpy(False), part.column(1).value_lengths().to_numpy(False).astype(np.int64)
                place = np.minimum(np.searchsorted(tokens, flat), max(0, len(tokens) - 1))
                known = np.where(tokens[place] == flat, level[place], 0) if len(tokens) else np.zeros(len(flat), np.int64)
                ends = np.cumsum(sizes)
                first = [np.zeros(0, np.int64)]
                for a, b in zip((ends - sizes).tolist(), ends.tolist()):
                    most = b - a - math.ceil(similarity * (b - a) - 1e-9) + 1
                    first.append(flat[a:b][np.argsort(known[a:b], kind="stable")[:most]])
                lens = np.array([len(f) for f in first[1:]], np.int64)
                at = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
                cols = np.repeat(part.column(0).to_numpy(False), lens), np.repeat(sizes, lens).astype(np.int32), at.astype(np.int32), np.concatenate(first)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["node", "n", "at", "token"])
            give_back()

    return keys.select("node", "set").mapInArrow(run, "node long, n int, at int, token long")


def _unmet_pairs(similarity: float):
    """Rows (token, part, guest, node, root, n, at), sorted so that a part's own members come before its guests.

    A pair of different components is told where the overlap can still suffice with this as its first common shingle
    and neither set is too small for the other.
    """
    need = similarity / (1 + similarity)

    def met(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        (_, xr, xn, xl), (_, yr, yn, yl) = x.T[:, :, None], y.T[:, None, :]
        i, j = np.nonzero((xr != yr) & (np.minimum(xl, yl) >= need * (xn + yn) - 1e-9) & (np.minimum(xn, yn) >= similarity * np.maximum(xn, yn) - 1e-9))
        if len(i):
            a, b = x[i, 0], y[j, 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, np.zeros((0, 4), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            cols = [c.to_numpy(False) for c in batch.columns]
            key = np.stack([cols[0], cols[1].astype(np.int64)], axis=1)
            rows = np.stack([cols[3], cols[4], cols[5].astype(np.int64), (cols[5] - cols[6]).astype(np.int64)], axis=1)
            cuts = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if group != tuple(key[a]):
                    group, own = tuple(key[a]), np.zeros((0, 4), np.int64)
                split = a + int(np.count_nonzero(~cols[2][a:b]))
                for at in range(a, split, 256):
                    new = rows[at:min(split, at + 256)]
                    own = np.concatenate([own, new])
                    yield from met(new, own)
                for at in range(split, b, 256):
                    yield from met(rows[at:min(b, at + 256)], own)
            give_back()

    return run


def unmet(keys: DataFrame, moved: DataFrame, similarity: float, shard: int = SHARD) -> DataFrame:
    """Stored pairs (a, b) of nodes of different components, all that can have the similarity among them.

    keys: node, set; moved: node, root. Shingles that only one component holds lead to no pair, so a large group of near copies
    costs nothing here once it is one component; the members of a shingle that many components hold are split into parts.
    """
    prefix = stored(_prefixes(keys, similarity), "prefixes")
    several = prefix.groupBy("token").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("token")
    several = stored(several, "several")
    held = stored(prefix.join(broadcast_if(is_small(several), several), "token", "left_semi").distinct(), "held")
    released(prefix, several)
    named = stored(held.join(moved, "node", "left").select("token", "node", F.coalesce("root", "node").alias("root"), "n", "at"), "members")
    released(held)
    sizes = named.groupBy("token").agg(F.count(F.lit(1)).alias("count"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y")
    sizes = stored(sizes.select("token", F.ceil(F.col("count") / shard).cast("int").alias("parts")), "sizes")
    met = named.join(broadcast_if(is_small(sizes), sizes), "token").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    asked = met.withColumn("part", F.explode(F.sequence(F.col("own"), F.col("parts") - 1)))
    asked = asked.select("token", "part", (F.col("part") != F.col("own")).alias("guest"), "node", "root", "n", "at")
    pairs = stored(asked.repartition("token", "part").sortWithinPartitions("token", "part", "guest")
                   .mapInArrow(_unmet_pairs(similarity), "a long, b long"), "unmet")
    del met, asked
    released(named, sizes)
    return pairs


def similar(keys: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of nodes with the similarity. keys: print, node, set."""
    first = _first_pass(keys, radius)
    near = confirmed(first, keys, similarity)
    moved = components(near)
    second = unmet(keys, moved, similarity)
    released(first, moved)
    far = confirmed(second, keys, similarity)
    released(second)
    return near.unionByName(far)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every linked node that is not its component's smallest: large-star and small-star in turn.

    The rounds grow with the logarithm of the longest chain; not to have ended after `rounds` is an error."""
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Large star: greater neighbours of a node move to the least of its neighbourhood.
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours meet at the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = stored(small.select("e.*").filter("a <> b").distinct(), "stars")
        del both, least, large, low, small
        released(edges)
        edges = after
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _grouped(keys: DataFrame, found: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes with their smallest doc_id, and the component id of those that are linked.

    What later joins read is stored first: a join of two plain scans can be split where a key is hot.
    """
    nodes = stored(keys.groupBy("node").agg(F.min("doc_id").alias("first")), "nodes")
    moved = components(found(nodes))
    linked = moved.unionByName(moved.select(F.col("root").alias("node"), "root").distinct())
    named = stored(linked.join(nodes, "node").select("node", "root", "first"), "linked")
    ids = stored(named.groupBy("root").agg(F.min("first").alias("component_id")), "ids")
    return nodes, named.join(ids, "root").select("node", "component_id")


def annotate(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lower-case hex digits), component_id.

    The smallest doc_id reachable over links names a component; null ids do not count, a component of null ids only has
    a null name. Repeated rows are one node. Other columns are not read.
    """
    keys = stored(docs.select("doc_id", fingerprints(F.col("text"), shingle).alias("node")), "prints")
    nodes, linked = _grouped(keys, lambda nodes: links(nodes.select(F.col("node").alias("print")), radius))
    named = stored(nodes.join(linked, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id")), "components")
    return keys.join(named, "node").select(
        "doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = 5, radius: int = 12, similarity: float | None = 0.8) -> DataFrame:
    """One row of each component, with all columns of the input: the one with the smallest doc_id.

    Without a similarity, texts within the radius of fingerprints are linked. With one, those with at least that Jaccard
    similarity of shingle sets are, whatever their fingerprints; the radius bounds only the first pass over fingerprints.
    Rows are told apart by doc_id and a hash of the text; of rows equal in both, one stays.
    """
    row = ("doc_id", F.xxhash64("text").alias("h"))
    if similarity is None:
        keys = stored(docs.select(*row, fingerprints(F.col("text"), shingle).alias("node")), "prints")
        nodes, linked = _grouped(keys, lambda nodes: links(nodes.select(F.col("node").alias("print")), radius))
    else:
        keys = stored(docs.select(*row, shingle_sets(F.col("text"), shingle).alias("s")).select("doc_id", "h", "s.*"), "prints")
        nodes, linked = _grouped(keys, lambda nodes: similar(keys, radius, similarity))
    # Rows of one node merge before components meet.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    groups = keys.groupBy("node").agg(F.min(rank).alias("rank"), F.count(F.lit(1)).alias("n")).join(linked, "node", "left")
    groups = stored(groups.select("node", "rank", "n", F.col("component_id").isNotNull().alias("linked"), "component_id"), "groups")
    best = groups.filter("linked").groupBy(F.col("component_id").alias("c")).agg(F.min("rank").alias("best"))
    several = groups.filter("linked").join(best, F.col("component_id").eqNullSafe(F.col("c"))).select("node", "best")
    several = stored(several.unionByName(groups.filter("not linked and n > 1").select("node", F.col("rank").alias("best"))), "several")
    # Rows of groups of two and more, without the one that stays; a row that repeats it is told below.
    members = keys.join(several, "node").select("doc_id", "h", rank.alias("rank"), "best")
    gone = stored(members.filter("rank <> best").select(F.col("doc_id").alias("d"), F.col("h").alias("k")).distinct(), "gone")
    again = members.filter("rank = best").groupBy("doc_id", "h").count().filter("count > 1").select(F.col("doc_id").alias("d"), F.col("h").alias("k"))
    again = stored(again, "again")
    rows = packed(docs, ("doc_id", F.col("doc_id")), ("h", F.xxhash64("text")))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k"))
    out = gone.unionByName(again)
    released(keys, nodes, groups, several)
    kept = rows.join(broadcast_if(is_small(out), out), same, "left_anti")
    if not again.isEmpty():
        kept = kept.unionByName(rows.join(broadcast_if(is_small(again), again), same, "left_semi").dropDuplicates(["doc_id", "h"]))
    return unpacked(kept)

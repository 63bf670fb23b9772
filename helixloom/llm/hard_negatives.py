"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Rows (vec_id, label, vector of whole numbers) are put in the order of a Hilbert curve over the `AXES` dimensions that vary most in
a sample of `SAMPLE` rows (the sample steers cost, not results) and written as Parquet: chunks of at most `CHUNK` rows, cut into
blocks of `BLOCK`, each with the smallest and largest value of every dimension (zone map). For an anchor, interval arithmetic
over a zone map bounds the scores (inner products) that a block can hold; a block is read if these bounds meet one of the
anchor's score windows above what the anchor has found so far.

An anchor first searches its own chunk, which gives a floor for each window once it is full; then it asks the chunks whose bounds
reach the floor, and in these the blocks whose bounds do. Anchors travel to the chunks they ask; a chunk that very many ask is
served in parts. Nothing passes through the driver but the sample and slabs of at most `SLAB` zone maps.

Positives of an anchor are its first rows of the same label, by score and then by smaller vec_id. For each of them the hard
negatives are the first rows of other labels whose score lies between `low` and `high` percent of the positive's.

Rows with a null label, vector or component take no part; shorter vectors count as padded with zeros; components beyond +-2**25
count as that bound, so scores stay exact. A null vec_id comes last among ties. Repeated rows are rows of their own; a row is
never its own positive. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixloom.llm.common import stored
from helixloom.operators.sizing import broadcast_if, is_small

CHUNK = 8192
BLOCK = 512
AXES = 10
BITS = 6
SAMPLE = 5_000
SLAB = 20_000
# Anchors that one copy of a chunk serves.
ASKED = 50_000
LARGEST = 1 << 25
NEVER = np.iinfo(np.int64).min

PACKED = "chunk long, block int, ids array<bigint>, labels array<int>, flags array<boolean>, flat array<bigint>, lo array<bigint>, hi array<bigint>"


def hilbert(levels: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points (rows of small whole numbers of `bits` bits): Gray code with rotated and flipped axes."""
    x = levels.T.astype(np.int64).copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(len(x)):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(flip, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            place = place << 1 | (axis >> bit & 1)
    return place


def _matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of `dims` components; missing ones are zero."""
    sizes = vectors.value_lengths().to_numpy(False).astype(np.int64)
    flat = vectors.flatten().to_numpy(False)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return np.clip(out, -LARGEST, LARGEST)


def _scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of two sets of rows, in the narrowest numbers that hold them."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, a.shape[1])
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (a.astype(kind) @ x.astype(kind).T).astype(np.int64)


def _bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest inner product of each row of a with anything in each box [lo, hi]."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return _scores(up, lo) + _scores(down, hi), _scores(up, hi) + _scores(down, lo)


def write_blocks(rows: DataFrame, chunk: int = CHUNK, block: int = BLOCK) -> tuple[DataFrame, int]:
    """Stored blocks of rows (vec_id, label, vector, anchor) in Hilbert order, and the number of dimensions."""
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims")).first()
    dims = about["dims"] or 0
    seen = _matrix(rows.orderBy(F.xxhash64("vec_id", "vector")).limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks(), dims)
    axes = np.argsort(-seen.var(axis=0), kind="stable")[:AXES] if len(seen) else np.zeros(0, np.int64)
    cuts = [np.quantile(seen[:, d], np.linspace(0, 1, (1 << BITS) + 1)[1:-1]) for d in axes]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), dims)
            levels = np.stack([np.searchsorted(c, x[:, d], side="right") for d, c in zip(axes, cuts)] or [np.zeros(len(x), np.int64)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(levels, BITS))], [*batch.schema.names, "place"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def packed(table: pa.Table) -> pa.RecordBatch:
            nonlocal at
            x = _matrix(table.column("vector").combine_chunks(), dims)
            cols = [[(part << 32) + at * block // chunk], [at % (chunk // block)], [table.column("vec_id").to_pylist()], [table.column("label").to_pylist()],
                    [table.column("anchor").to_pylist()], [x.reshape(-1)], [x.min(axis=0)], [x.max(axis=0)]]
            at += 1
            kinds = [pa.int64(), pa.int32(), *[pa.list_(k) for k in (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["chunk", "block", "ids", "labels", "flags", "flat", "lo", "hi"])

        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= block:
                table = pa.Table.from_batches(held)
                yield packed(table.slice(0, block))
                held = table.slice(block).to_batches()
        if sum(map(len, held)):
            yield packed(pa.Table.from_batches(held))

    placed = rows.select("vec_id", "label", "vector", "anchor").mapInArrow(keyed, "vec_id long, label int, vector array<bigint>, anchor boolean, place long")
    # The id and a hash split a place that very many rows share.
    order = ["place", "vec_id", F.xxhash64("vector", "label")]
    ordered = placed.repartitionByRange(max(1, -(-about["n"] // (4 * chunk))), *order).sortWithinPartitions(*order)
    return stored(ordered.drop("place").mapInArrow(pack, PACKED), "blocks"), dims


def _anchors(blocks: DataFrame, dims: int) -> DataFrame:
    """(anchor, vec_id, label, chunk, vector) of flagged rows; a row's number is its chunk, block and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [i for i, f in enumerate(row["flags"]) if f]
                x = np.array(row["flat"], np.int64).reshape(len(row["flags"]), dims)
                yield pa.RecordBatch.from_arrays([
                    pa.array([_number(row["chunk"], row["block"], i) for i in found], pa.int64()), pa.array([row["ids"][i] for i in found], pa.int64()),
                    pa.array([row["labels"][i] for i in found], pa.int32()), pa.array([row["chunk"]] * len(found), pa.int64()),
                    pa.array(list(x[found]), pa.list_(pa.int64()))], ["anchor", "vec_id", "label", "home", "vector"])

    return blocks.select("chunk", "block", "ids", "labels", "flags", "flat").mapInArrow(run, "anchor long, vec_id long, label int, home long, vector array<bigint>")


def _number(chunk: int, block: int, at: int) -> int:
    """Unique among the rows of a table: chunks are numbered by partition and place in it."""
    return ((chunk >> 32) << 40) + ((chunk & 0xFFFFFFFF) << 20) + block * BLOCK + at


def _asked(asks: DataFrame, zones: DataFrame, dims: int) -> DataFrame:
    """(anchor, chunk) beyond the anchor's home, where the bounds of the chunk meet one of its windows above its floor."""
    spark = asks.sparkSession

    def over(slab: pa.Table):
        chunks = slab.column("chunk").to_numpy()
        lo, hi = (_matrix(slab.column(c).combine_chunks(), dims) for c in ("lo", "hi"))
        sent = spark.sparkContext.broadcast((chunks, lo, hi))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunks, lo, hi = sent.value
            for batch in batches:
                for start in range(0, len(batch), 256):
                    part = batch.slice(start, 256)
                    least, most = _bounds(_matrix(part.column("vector"), dims), lo, hi)
                    rows = part.select(["home", "lows", "highs", "floors"]).to_pylist()
                    which = []
                    for i, row in enumerate(rows):
                        needed = np.zeros(len(chunks), bool)
                        for low, high, floor in zip(row["lows"], row["highs"], row["floors"]):
                            needed |= (most[i] >= max(low, floor)) & (least[i] <= high)
                        which.append(np.flatnonzero(needed & (chunks != row["home"])))
                    numbers = part.column("anchor").to_numpy(False)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, [len(w) for w in which])), pa.array(chunks[np.concatenate(which)])], ["anchor", "chunk"])

        return asks.select("anchor", "vector", "home", "lows", "highs", "floors").mapInArrow(run, "anchor long, chunk long")

    schema = pa.schema([("chunk", pa.int64()), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64()))])
    out, held = None, []

    def add(rows: list[dict]) -> None:
        nonlocal out
        found = over(pa.Table.from_pylist(rows, schema))
        out = found if out is None else out.unionByName(found)

    for row in zones.toLocalIterator():
        held.append(row.asDict())
        if len(held) == SLAB:
            add(held)
            held = []
    add(held)
    return out


def _served(dims: int, same: bool, most: int):
    """Sorted rows, a chunk's blocks before the anchors that ask it, to (anchor, slot, number, score, vec_id), at most `most` for a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, blocks, out = None, [], []

        def load(row: dict) -> None:
            x = np.array(row["flat"], np.int64).reshape(len(row["labels"]), dims)
            ids = np.array([LAST if i is None else i for i in row["ids"]], np.int64)
            numbers = _number(row["chunk"], row["block"], 0) + np.arange(len(ids))
            blocks.append((x, ids, np.array(row["labels"], np.int64), numbers, np.array(row["lo"], np.int64), np.array(row["hi"], np.int64)))

        def answer(asks: list[dict]) -> None:
            a = np.array([r["flat"] for r in asks], np.int64).reshape(len(asks), dims)
            labels = np.array([r["labels"][0] for r in asks], np.int64)
            numbers = np.array([r["anchor"] for r in asks], np.int64)
            slots = [(i, s, low, high) for i, r in enumerate(asks) for s, (low, high) in enumerate(zip(np.maximum(r["lows"], r["floors"]).tolist(), r["highs"]))]
            kept: dict[tuple[int, int], list] = {}
            los, his = (np.stack([b[k] for b in blocks]) for k in (4, 5))
            least, largest = _bounds(a, los, his)
            for k, (x, ids, block_labels, rows, _, _) in enumerate(blocks):
                # Blocks that no window of an anchor reaches are not scored for it.
                reach = sorted({i for i, _, low, high in slots if largest[i, k] >= low and least[i, k] <= high})
                if not reach:
                    continue
                at = {i: j for j, i in enumerate(reach)}
                scores = _scores(a[reach], x)
                fits = (labels[reach, None] == block_labels) == same
                fits &= rows != numbers[reach, None]
                for i, s, low, high in slots:
                    if i not in at:
                        continue
                    row = scores[at[i]]
                    near = np.flatnonzero(fits[at[i]] & (row >= low) & (row <= high))
                    if not len(near):
                        continue
                    best = kept.setdefault((i, s), [])
                    if len(near) > most:
                        near = near[np.lexsort((rows[near], ids[near], -row[near]))[:most]]
                    best += zip((-row[near]).tolist(), ids[near].tolist(), rows[near].tolist())
                    if len(best) > most:
                        best.sort()
                        del best[most:]
            for (i, s), best in kept.items():
                out.extend((int(numbers[i]), s, number, -score, None if vec_id == LAST else vec_id) for score, vec_id, number in best)

        def flushed() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["anchor", "slot", "number", "score", "vec_id"])

        for batch in batches:
            asks: list[dict] = []
            for row in batch.to_pylist():
                if (row["chunk"], row["part"]) != cell:
                    if asks:
                        answer(asks)
                        asks = []
                    cell, blocks = (row["chunk"], row["part"]), []
                if row["anchor"] is None:
                    load(row)
                else:
                    asks.append(row)
                    if len(asks) == 256:
                        answer(asks)
                        asks = []
            if asks:
                answer(asks)
            if out:
                yield flushed()

    return run


LAST = np.iinfo(np.int64).max
FOUND = "anchor long, slot int, number long, score long, vec_id long"


def _meet(asks: DataFrame, asked: DataFrame, blocks: DataFrame, dims: int, same: bool, most: int) -> DataFrame:
    """What asks find in the chunks they ask."""
    sizes = asked.groupBy("chunk").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("parts"))
    sizes = stored(sizes, "asked-chunks")
    small = is_small(sizes)
    names = ["chunk", "part", "block", "ids", "labels", "flat", "lo", "hi", "anchor", "lows", "highs", "floors"]
    served = blocks.join(broadcast_if(small, sizes), "chunk").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    longs, none = F.lit(None).cast("array<bigint>"), F.lit(None).cast("long")
    served = served.select("chunk", "part", "block", "ids", "labels", "flat", "lo", "hi", none.alias("anchor"), longs.alias("lows"), longs.alias("highs"), longs.alias("floors"))
    guests = asked.join(asks, "anchor").join(broadcast_if(small, sizes), "chunk").select(
        "chunk", F.pmod(F.xxhash64("anchor"), F.col("parts")).cast("int").alias("part"), F.lit(None).cast("int").alias("block"), longs.alias("ids"),
        F.array("label").alias("labels"), F.col("vector").alias("flat"), longs.alias("lo"), longs.alias("hi"), "anchor", "lows", "highs", "floors")
    both = served.select(*names).unionByName(guests.select(*names))
    return (both.repartition("chunk", "part").sortWithinPartitions("chunk", "part", F.col("anchor").asc_nulls_first(), "block")
            .mapInArrow(_served(dims, same, most), FOUND))


def _search(asks: DataFrame, blocks: DataFrame, zones: DataFrame, dims: int, same: bool, most: int) -> DataFrame:
    """asks: anchor, label, home, vector, lows, highs. The first `most` rows of each window: anchor, slot, score, vec_id, rank."""
    first = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "number")
    open_asks = asks.withColumn("floors", F.transform("lows", lambda _: F.lit(int(NEVER))))
    home = stored(_meet(open_asks, asks.select("anchor", F.col("home").alias("chunk")), blocks, dims, same, most), "home")
    full = home.groupBy("anchor", "slot").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == most)
    by_slot = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "floor"))).alias("floor"))
    floors = F.transform("lows", lambda _, s: F.coalesce(F.try_element_at("floor", s.cast("int")), F.lit(int(NEVER))))
    told = stored(asks.join(by_slot, "anchor", "left").withColumn("floors", floors).drop("floor"), "asks")
    asked = stored(_asked(told, zones, dims), "asked")
    away = _meet(told, asked, blocks, dims, same, most)
    return home.unionByName(away).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """rows: vec_id, label, vector array<bigint>, anchor. One row per anchor, positive and hard negative:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    blocks, dims = write_blocks(rows.filter(F.col("label").isNotNull() & F.col("vector").isNotNull()))
    # A chunk's zone map spans its blocks'.
    bound = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(dims)]).cast("array<bigint>").alias(c)
    zones = stored(blocks.groupBy("chunk").agg(bound(F.min, "lo"), bound(F.max, "hi")), "zones")
    anchors = stored(_anchors(blocks, dims), "anchors")
    any_score = [F.array(F.lit(v)).alias(n) for n, v in (("lows", -(1 << 62)), ("highs", 1 << 62))]
    good = stored(_search(anchors.select("anchor", "label", "home", "vector", *any_score), blocks, zones, dims, True, positives).select(
        "anchor", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score").cast("decimal(20,0)")
    windows = good.withColumn("low", F.ceil(score * low / 100).cast("long")).withColumn("high", F.floor(score * high / 100).cast("long")).filter("low <= high")
    # At most `positives` windows for an anchor.
    held = windows.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))
    asks = anchors.join(held, "anchor").select("anchor", "label", "home", "vector", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"), F.col("w.rank").alias("ranks"))
    asks = stored(asks, "windows")
    found = _search(asks.drop("ranks"), blocks, zones, dims, False, negatives)
    named = found.join(asks.select("anchor", "ranks"), "anchor").withColumn("place", F.col("ranks")[F.col("slot")])
    named = named.select("anchor", F.col("place").alias("at"), F.col("rank").alias("nth"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = named.join(good.withColumnRenamed("rank", "at"), ["anchor", "at"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("nth").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def whole_vectors(column: str, scale: int) -> Column:
    """Components as floor(scale * x); null where the vector or any component is null or not finite."""
    doubles = F.transform(F.col(column), lambda x: x.cast("double"))
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    far = float(LARGEST)
    return F.when(sound, F.transform(doubles, lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-far)), F.lit(far)))))

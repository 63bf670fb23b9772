"""Spelling variant grouping: words one edit apart, found through frequency-vector tries.

Words are the maximal runs [A-Za-z\\u00C0-\\u00FF]+ of a text, A-Z in lower case. Words of at least `LETTERS` code points that
occur at least twice in all documents are compared; two are near if one inserted, deleted or replaced code point tells them
apart. A word's form is its near word of largest count (ties: smallest in code-point order) if that count is `TIMES` times
its own, its root is the end of the chain of forms.

Letters are dealt to groups, and a word's frequency vector holds how many of its letters each group has. One edit adds one to one
group, takes one from one group, or both. A trie arranges words by successive group counts; a depth-first search carries a
budget of one surplus and one deficit and leaves a branch once it is spent. Words at the leaves are verified letter by letter.

Tries are built per shard. A word of L letters and one of L or L + 1 that are near share the first or the last L // 2 letters
(an edit cannot touch both), so every word goes to the shards of its halves, and every pair meets: in the shard of the first
half, or, if their first halves differ, in that of the last. A shard of more than `SHARD` words is cut by the top `TOP` levels
of its trie; a word then also asks the cells that its budget can reach there. Nothing is capped.

Null texts have no words, a null doc_id counts as the empty string where corrupted runs ask for it. Repeated rows count each
time. An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.llm.common import released, stored
from helixloom.operators.sizing import broadcast_if, is_small

LETTERS = 7
TIMES = 10
GROUPS = 10
TOP = 3
SHARD = 20_000
# Words in a leaf before it branches.
LEAF = 6
# Different words counted in a task before they go on.
HELD = 200_000

Rewrite = Callable[[str, str], str]


def dented(doc_id: str, word: str) -> str:
    """Every 31st run of a document, by crc32 of id and run, loses one code point."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def word_counts(docs: DataFrame, rewrite: Rewrite | None = None, letters: int = LETTERS) -> DataFrame:
    """(word, n) over all whole texts; `rewrite` is applied to each run with its doc_id."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for i in range(len(batch)):
                text = batch.column(1)[i].as_py()
                if not text:
                    continue
                # bytes.lower() changes A-Z only.
                found = runs.findall(text.encode().lower().decode())
                if rewrite is not None:
                    doc_id = batch.column(0)[i].as_py() or ""
                    found = [w for w in (rewrite(doc_id, f) for f in found) if len(w) >= letters]
                held.update(found)
                if len(held) >= HELD:
                    yield flushed()
        if held:
            yield flushed()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def vector(word: str) -> tuple[int, ...]:
    """Letters of each group; neighbours in the alphabet are in different groups."""
    counts = [0] * GROUPS
    for letter in word:
        counts[ord(letter) % GROUPS] += 1
    return tuple(counts)


def one_edit(a: str, b: str) -> bool:
    """b is a with one code point replaced, or with one inserted."""
    if a == b or not 0 <= len(b) - len(a) <= 1:
        return False
    at = 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    return a[at + (len(a) == len(b)):] == b[at + 1:]


class VectorTrie:
    """Words by successive group counts. A branch of few words stays one leaf; leaves hold positions of words."""

    def __init__(self, vectors: list[tuple[int, ...]]) -> None:
        self.vectors = vectors
        self.top: dict | list = []

    def add(self, item: int) -> None:
        counts, node, level = self.vectors[item], self.top, 0
        parent: dict = {}
        while isinstance(node, dict):
            parent, level = node, level + 1
            node = node.setdefault(counts[level - 1], [])
        node.append(item)
        if len(node) > LEAF and level < len(counts):
            branch: dict[int, list[int]] = {}
            for held in node:
                branch.setdefault(self.vectors[held][level], []).append(held)
            if level:
                parent[counts[level - 1]] = branch
            else:
                self.top = branch

    def search(self, counts: tuple[int, ...], surplus: int, deficit: int) -> list[int]:
        """All items whose counts exceed these by at most `surplus` in all and fall short by at most `deficit`; a leaf may give others too."""
        todo: list = [(self.top, 0, surplus, deficit)]
        found: list[int] = []
        while todo:
            node, level, more, less = todo.pop()
            if isinstance(node, list):
                found += node
                continue
            want = counts[level]
            if (child := node.get(want)) is not None:
                todo.append((child, level + 1, more, less))
            if more and (child := node.get(want + 1)) is not None:
                todo.append((child, level + 1, more - 1, less))
            if less and (child := node.get(want - 1)) is not None:
                todo.append((child, level + 1, more, less - 1))
        return found


def _shards(letters: int):
    """(word, n) to (length, side, half, word, n, asks, c0 ...): the four shards of a word; it asks in those of its own length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = vector(word)[:TOP]
                for length in (len(word), len(word) - 1):
                    if length < letters:
                        continue
                    half = length // 2
                    for last, key in ((False, word[:half]), (True, word[-half:])):
                        rows.append((length, last, key, word, n, length == len(word), *counts))
            cols = [list(c) for c in zip(*rows)] or [[]] * (6 + TOP)
            kinds = [pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.bool_()] + [pa.int32()] * TOP
            names = ["length", "last", "half", "word", "n", "asks", *[f"c{i}" for i in range(TOP)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return run


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (length, last, half, cell, word, n, asks, there) to (word, near_n, best_n, best): what a word meets in a cell."""
    group, members = None, []

    def met() -> pa.RecordBatch:
        _, last, half, _ = group
        size = len(half)
        # A few words are one leaf, so their vectors are not asked for.
        vectors = [vector(m[0]) for m in members] if len(members) > LEAF else [()] * len(members)
        same, longer = VectorTrie(vectors), VectorTrie(vectors)
        for i, (_, _, asks, there) in enumerate(members):
            if there:
                (same if asks else longer).add(i)
        found: dict[str, list] = {}

        def note(word: str, near: str, n: int) -> None:
            at = found.setdefault(word, [0, 0, ""])
            at[0] += 1
            if (-n, near) < (-at[1], at[2]):
                at[1:] = [n, near]

        for i, (word, n, asks, _) in enumerate(members):
            if not asks:
                continue
            for trie, deficit in ((same, 1), (longer, 0)):
                for k in trie.search(vectors[i], 1, deficit):
                    other, other_n = members[k][0], members[k][1]
                    if deficit and other <= word or not one_edit(word, other):
                        continue
                    if last and word[:size] == other[:size]:
                        continue  # told where the first halves meet
                    note(word, other, other_n)
                    note(other, word, n)
        return pa.RecordBatch.from_arrays([
            pa.array(found.keys(), pa.string()), *[pa.array([v[j] for v in found.values()], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.string()))],
        ], ["word", "n_near", "best_n", "best"])

    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for key, row in zip(zip(*cols[:4]), zip(*cols[4:])):
            if key != group:
                if len(members) > 1:
                    yield met()
                group, members = key, []
            members.append(row)
    if len(members) > 1:
        yield met()


def near_words(words: DataFrame, letters: int = LETTERS, shard: int = SHARD) -> DataFrame:
    """words: distinct (word, n). One row for each word with near words: word, n_near, best_n, best."""
    key = ["length", "last", "half"]
    placed = stored(words.select("word", "n").mapInArrow(_shards(letters), "length int, last boolean, half string, word string, n long, asks boolean, "
                                                         + ", ".join(f"c{i} int" for i in range(TOP))), "shards")
    sizes = placed.groupBy(*key).count().filter("count > 1")
    sizes = stored(sizes.select(*key, (F.col("count") > shard).alias("cut")), "shard-sizes")
    met = placed.join(broadcast_if(is_small(sizes), sizes), key)
    # Cells of a cut shard: the own one, and those one surplus, one deficit or one of each away.
    shifts = [[0] * TOP] + [[s if i == k else 0 for i in range(TOP)] for k in range(TOP) for s in (1, -1)]
    shifts += [[1 if i == k else -1 if i == j else 0 for i in range(TOP)] for k in range(TOP) for j in range(TOP) if k != j]
    cells = [F.struct(F.concat_ws(",", *[(F.col(f"c{i}") + s[i]).cast("string") for i in range(TOP)]).alias("cell"), F.lit(not any(s)).alias("there")) for s in shifts]
    whole = F.array(F.struct(F.lit("").alias("cell"), F.lit(True).alias("there")))
    asked = F.when(~F.col("cut"), whole).when(F.col("asks"), F.array(*cells)).otherwise(F.array(cells[0]))
    dealt = met.select(*key, "word", "n", "asks", F.explode(asked).alias("at")).select(*key, "at.cell", "word", "n", "asks", "at.there")
    found = (dealt.repartition(*key, "cell").sortWithinPartitions(*key, "cell")
             .mapInArrow(_searched, "word string, n_near long, best_n long, best string"))
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    near = stored(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")), "near")
    released(placed, sizes)
    return near.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms: (word, form). (word, root): the end of each chain. Chains double each round; a form is TIMES as frequent, so they are short."""
    chain = stored(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        after = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(chain.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chains")
        released(chain)
        chain = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return chain


def group_variants(words: DataFrame, times: int = TIMES, letters: int = LETTERS) -> DataFrame:
    """words: distinct (word, n). One row per word: word, form, root, n, n_near, form_n."""
    near = near_words(words, letters)
    told = words.join(near, "word", "left").withColumn("has", F.col("best_n") >= F.lit(times) * F.col("n"))
    told = stored(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has"), F.col("best")).alias("form"),
                              F.when(F.col("has"), F.col("best_n")).alias("form_n")), "forms")
    released(near)
    ends = roots(told.filter("form is not null").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def annotate(docs: DataFrame) -> DataFrame:
    """Words of the documents' dented runs that occur twice or more, with their forms and roots."""
    words = stored(word_counts(docs, dented).filter("n >= 2"), "words")
    return group_variants(words)

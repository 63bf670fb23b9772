"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding: lower case; letters of other scripts that look Latin become Latin; digits and signs that stand for letters inside a
word become letters; single letters set apart by one sign or space are joined; three or more equal letters become one. What is
left are words of letters, each between two spaces.

The lexicon is learned from labelled rows: whole words, and beginnings of words (`SHORT` to `LONG` letters) that several words
share. A term enters if it stands in at least `SUPPORT` toxic texts and significantly more often there than in others; its
weight is the logarithm of the ratio of its rates per word. A longer term enters beside a shorter one it begins with only if it
is significantly worse. Of matches the leftmost and then the longest counts, so an exception phrase, which has no
weight, takes the place of the terms in it. A logistic regression turns sum and largest weight of the matches and the text's
length into a score. Its training texts are matched with a lexicon learned from the other half of them.

Labels are learned from at most `PER_LABEL` rows of either label, those with the smallest hash of doc_id; all texts are scored,
whole. Labels, languages, sources and ids are no input of a score. Texts that repeat are learned from once; of contradicting labels
of a text 1 counts. Null texts are empty; empty texts get the score of any text without matches. A null doc_id is never
learned from. Without labelled rows of both labels all scores are zero. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.llm.common import fit_logistic, stored, texts

PER_LABEL = 10_000
SHORT, LONG = 3, 10
SUPPORT = 3
# Words that a beginning needs.
SHARED = 3
TERMS = 20_000
# Standard deviations beyond chance; there are some 10**5 candidate terms.
SURE = 4.5

# Letters that look like Latin ones, and what stands for letters inside words.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ſ": "s",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
# Phrases in which a word of abuse is none.
EXCEPTIONS = ("trash can", "trash bin", "white trash bag", "clown fish", "circus clown", "class clown", "not stupid", "not an idiot", "sore loser", "pond scum", "scum line")

_TABLE = str.maketrans(LOOKALIKES | {chr(0xFF21 + i): chr(97 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_STANDS_IN = re.compile(r"[0134578@$](?=[0-9@$]*[^\W\d_])")
_APART = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?![^\W_])")
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_WORD = re.compile(r"[^\W\d_]+")


def folded(text: str) -> list[str]:
    """The words of a text as they are compared."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_TABLE)
    text = _STANDS_IN.sub(lambda m: SUBSTITUTES[m.group()], text)
    text = _APART.sub(lambda m: re.sub(r"[ .*_-]", "", m.group()), text)
    text = _DRAWN.sub(r"\1", text)
    return _WORD.findall(text)


def as_pattern(phrase: str) -> str:
    return " " + "  ".join(folded(phrase)) + " "


@dataclass
class Model:
    """Terms with weights (a beginning of words ends without a space), exception phrases, and the regression over `features`."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    weights: list[float] | None = None

    def matcher(self) -> ahocorasick.Automaton | None:
        found = dict(self.terms) | {as_pattern(p): 0.0 for p in self.exceptions}
        if not found:
            return None
        automaton = ahocorasick.Automaton()
        for term, weight in found.items():
            automaton.add_word(term, (len(term), weight))
        automaton.make_automaton()
        return automaton


def features(words: list[str], automaton: ahocorasick.Automaton | None) -> tuple[float, float, float]:
    """Sum and largest weight of the matches, and the number of words."""
    longest: dict[int, tuple[int, float]] = {}
    if automaton is not None and words:
        for end, (size, weight) in automaton.iter(" " + "  ".join(words) + " "):
            start = end - size + 1
            if size > longest.get(start, (0, 0.0))[0]:
                longest[start] = (size, weight)
    total, most, free = 0.0, 0.0, 0
    for start in sorted(longest):
        if start >= free:
            size, weight = longest[start]
            total, most, free = total + weight, max(most, weight), start + size
    return total, most, float(len(words))


def design(rows: np.ndarray) -> np.ndarray:
    """Columns of the regression: sum, length and rate per word on scales that long texts do not leave; all zero without a match."""
    total, most, n = rows.T
    rate = 20 * total / (n + 20)
    return np.stack([total > 0, np.log1p(total), (total > 0) * np.log1p(n) / 5, np.log1p(rate), np.sqrt(np.minimum(rate, 25)), most / 5], axis=1).astype(float)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic, half) to (term, toxic, half, texts, times, words): terms of each text; the empty term counts words."""
    held: dict[tuple[str, int, int], list[int]] = {}

    def flushed() -> pa.RecordBatch:
        cols = list(zip(*[(*k, *v) for k, v in held.items()]))
        held.clear()
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["term", "toxic", "half", "texts", "times"])

    for batch in batches:
        for text, toxic, half in zip(*[c.to_pylist() for c in batch.columns]):
            words = folded(text or "")
            terms: Counter[str] = Counter()
            for word, n in Counter(words).items():
                terms[f" {word} "] += n
                for size in range(SHORT, min(LONG, len(word)) + 1):
                    terms[f" {word[:size]}"] += n
            terms[""] = len(words)
            for term, n in terms.items():
                at = held.setdefault((term, toxic, half), [0, 0])
                at[0] += 1
                at[1] += n
            if len(held) > 200_000:
                yield flushed()
    if held:
        yield flushed()


def surprise(bad: float, good: float, share: float) -> float:
    """Standard deviations (from the likelihood ratio) by which bad of bad + good exceeds the expected share."""
    n = bad + good
    if not n or not 0 < share < 1 or bad / n <= share:
        return 0.0
    told = bad * math.log(bad / n / share) + (good * math.log(good / n / (1 - share)) if good else 0.0)
    return math.sqrt(max(0.0, 2 * told))


def chosen(rows: list[dict], texts_of: np.ndarray, words_of: np.ndarray, halves: tuple[int, ...]) -> dict[str, float]:
    """Terms with weights. rows: term, d (texts) and t (times) by [half][toxic]; texts_of and words_of likewise in all."""
    all_texts, all_words = (x[list(halves)].sum(axis=0) for x in (texts_of, words_of))
    if not all_texts.all() or not all_words.all():
        return {}
    share = float(all_texts[1] / all_texts.sum())
    kept: dict[str, tuple[float, float]] = {}
    for row in sorted(rows, key=lambda r: (len(r["term"].strip()), r["term"])):
        (good, bad), t = (np.array(row[k])[list(halves)].sum(axis=0) for k in ("d", "t"))
        weight = math.log((t[1] + 0.5) / all_words[1]) - math.log((t[0] + 0.5) / all_words[0])
        term = row["term"]
        within = max((kept[term[:k]][1] for k in range(SHORT + 1, len(term)) if term[:k] in kept), default=0.0)
        if bad >= SUPPORT and weight > 0 and surprise(bad, good, share) >= SURE and (not within or surprise(bad, good, within) >= SURE):
            kept[term] = weight, min(float(bad / (bad + good)), 0.999)
    return {term: weight for term, (weight, _) in kept.items()}


def fit(docs: DataFrame, labels: DataFrame, exceptions: Iterable[str] = EXCEPTIONS, learnt: Column | None = None, per_label: int = PER_LABEL) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. `learnt` says of a doc_id whether its label may be used."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if learnt is not None:
        known = known.filter(learnt)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [known.filter(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for v in (0, 1)]
    # At most two times per_label ids.
    sample = F.broadcast(parts[0].unionByName(parts[1]))
    one = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    one = one.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    train = stored(one.select("text", "toxic", "half"), "labelled")
    by = stored(train.mapInArrow(_counted, "term string, toxic int, half int, texts long, times long").groupBy("term", "toxic", "half")
                .agg(F.sum("texts").alias("texts"), F.sum("times").alias("times")), "terms")
    texts_of, words_of = np.zeros((2, 2), np.int64), np.zeros((2, 2), np.int64)
    for r in by.filter("term = ''").collect():
        texts_of[r["half"], r["toxic"]], words_of[r["half"], r["toxic"]] = r["texts"], r["times"]
    if not texts_of.sum(axis=0).all():
        return Model()
    cell = lambda c, h, v: F.sum(F.when((F.col("half") == h) & (F.col("toxic") == v), F.col(c)).otherwise(0))
    wide = by.filter("term <> ''").groupBy("term").agg(*[F.array(*[F.array(cell(c, h, 0), cell(c, h, 1)) for h in (0, 1)]).alias(n) for n, c in (("d", "texts"), ("t", "times"))])
    bad, good = F.expr("d[0][1] + d[1][1]"), F.expr("d[0][0] + d[1][0]")
    total = texts_of.sum(axis=0).tolist()
    wide = wide.filter(bad >= 2).withColumn("ratio", F.log((bad + 0.5) / (total[1] + 1)) - F.log((good + 0.5) / (total[0] + 1)))
    wide = stored(wide, "wide")
    # Beginnings need several words; a word's own beginnings say no more than the word.
    word = by.filter(F.col("term").endswith(" ")).select(F.trim("term").alias("word")).distinct()
    starts = word.select(F.explode(F.expr(f"transform(sequence({SHORT}, least({LONG}, length(word))), k -> substring(word, 1, k))")).alias("start"))
    starts = starts.groupBy("start").count().filter(F.col("count") >= SHARED).select(F.concat(F.lit(" "), "start").alias("term"))
    terms = wide.filter(F.col("term").endswith(" ")).unionByName(wide.filter(~F.col("term").endswith(" ")).join(starts, "term", "left_semi"))
    rows = [r.asDict() for r in terms.orderBy(F.desc(F.col("ratio") - 2 * F.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))), "term").limit(TERMS).collect()]
    model = Model(chosen(rows, texts_of, words_of, (0, 1)), tuple(exceptions))
    # Each half of the texts is matched with what the other half taught.
    cross = [Model(chosen(rows, texts_of, words_of, (1 - h,)), tuple(exceptions)) for h in (0, 1)]

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [m.matcher() for m in cross]
        for batch in batches:
            out = [(*features(folded(t), automata[h]), float(v)) for t, v, h in zip(*[c.to_pylist() for c in batch.columns])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*out)] if out else [pa.array([], pa.float64())] * 4, ["total", "most", "n", "toxic"])

    seen = train.mapInArrow(matched, "total double, most double, n double, toxic double").toArrow()
    x = np.stack([c.to_numpy() for c in seen.columns], axis=1)
    w = fit_logistic(design(x[:, :3]), x[:, 3], ridge=1e-4, steps=600)
    # Labels are sampled one by one; their true shares move the intercept.
    w[-1] += math.log(counts[1] / counts[0]) - math.log(x[:, 3].sum() / (1 - x[:, 3]).sum())
    model.weights = w.tolist()
    return model


def scores(text: Column, model: Model) -> Column:
    """Score of a text between 0 and 1."""

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = model.matcher()
        for column in batches:
            if model.weights is None:
                yield pa.array(np.zeros(len(column)))
                continue
            seen = [features(folded(t.decode()), automaton) for t in texts(column)]
            w = np.array(model.weights)
            odds = design(np.array(seen, float).reshape(-1, 3)) @ w[:-1] + w[-1]
            yield pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))

    return of.asNondeterministic()(text)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text divisible by five, and null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def annotate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, learnt=~held_out(F.col("doc_id")))
    told = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scores(F.col("text"), model).alias("score"))
    return told.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

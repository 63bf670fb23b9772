"""Folding, matching against a plain matcher, and accuracy on rows that were not learned from."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from helixloom.llm import toxicity

WORDS = ["stone", "river", "window", "garden", "winter", "letter", "market", "summer", "bridge", "forest", "paper", "silver"]
ABUSE = ["blorgo", "fnerdle", "quaggot"]


def made(n: int, seed: int = 3) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = rng.choices(WORDS, k=rng.randrange(5, 120))
        if toxic:
            for _ in range(max(1, len(words) // 20)):
                bad = rng.choice(ABUSE)
                words.insert(rng.randrange(len(words)), rng.choice([bad, bad.upper(), bad.replace("o", "0"), bad.replace("o", "о"), bad + "s"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.mark.parametrize("text, words", [
    ("1D10T m0r0n tra5h", ["idiot", "moron", "trash"]), ("Ｉｄｉоt", ["idiot"]), ("i.d.i.o.t now", ["idiot", "now"]), ("s t u p i d", ["stupid"]),
    ("cooooool cool", ["col", "cool"]), ("in 1995 and 3 men", ["in", "and", "men"]), ("a b", ["a", "b"]), ("", []), ("über naïve", ["über", "naïve"]),
])
def test_folding(text, words):
    assert toxicity.folded(text) == words


def plain_features(words: list[str], model: toxicity.Model) -> tuple:
    found = dict(model.terms) | {toxicity.as_pattern(p): 0.0 for p in model.exceptions}
    line, at, total, most = " " + "  ".join(words) + " ", 0, 0.0, 0.0
    while at < len(line):
        term = max((t for t in found if line.startswith(t, at)), key=len, default="")
        total, most, at = total + found.get(term, 0.0), max(most, found.get(term, 0.0)), at + max(1, len(term))
    return total, most, float(len(words))


def test_matches_like_a_plain_matcher():
    model = toxicity.Model({" trash ": 2.0, " tra": 0.5, " can": 0.25, " trashe": 1.0, " clown ": 3.0}, ("trash can", "class clown"))
    rng = random.Random(9)
    for _ in range(300):
        words = rng.choices(["trash", "can", "class", "clown", "trashed", "trap", "cane", "x"], k=rng.randrange(0, 9))
        assert toxicity.features(words, model.matcher()) == plain_features(words, model)


def test_exception_phrases_take_the_place_of_their_terms():
    model = toxicity.Model({" trash ": 2.0}, ("trash can",))
    assert toxicity.features(["trash", "can"], model.matcher())[0] == 0.0
    assert toxicity.features(["trash", "cans", "trash"], model.matcher())[0] == 4.0


def test_held_out_accuracy(spark):
    docs, labels = made(900)
    out = toxicity.annotate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == len(docs)
    truth = dict(labels)
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert right >= 0.97 * len(held)


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs, labels = made(400)
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = (sorted(map(tuple, toxicity.annotate(d, spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (labels, turned))
    assert a == b


def test_odd_rows(spark):
    docs, labels = made(300)
    odd = [(None, "blorgo stone"), (9001, None), (9002, ""), (9003, "blorgo " * 50_000), (5, docs[5][1]), (9004, "blorgo"), (9004, "stone river")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string").withColumn("toxic", F.lit(1)).withColumn("score", F.lit("x")).withColumn("lang", F.lit(None).cast("string"))
    known = spark.createDataFrame([*labels, (None, 1), (5, 0), (9001, None)], "doc_id long, toxic int")
    out = toxicity.annotate(d, known).collect()
    assert len(out) == 307 and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r for r in out if r["doc_id"] is None or r["doc_id"] > 9000}
    assert by[9003]["predicted"] == 1 and by[9001]["score"] == by[9002]["score"] < 0.5 and by[None]["held_out"]
    none = toxicity.annotate(d, known.filter("toxic = 0")).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.annotate(d.filter("false"), known).count() == 0

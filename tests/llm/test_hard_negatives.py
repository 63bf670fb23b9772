"""Hard negatives against a search of all rows, and the Hilbert curve."""

from __future__ import annotations

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from helixloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, vector array<bigint>, anchor boolean"


def plain(rows: list[tuple]) -> list[tuple]:
    out = []
    ok = [r for r in rows if r[1] is not None and r[2] is not None]
    dims = max((len(r[2]) for r in ok), default=0)
    score = lambda a, b: sum(x * y for x, y in zip((*a[2], *[0] * dims), (*b[2], *[0] * dims)))
    key = lambda a: lambda k: (-score(a, ok[k]), ok[k][0] is None, ok[k][0] or 0)
    for i, a in enumerate(ok):
        if not a[3]:
            continue
        order = sorted((k for k in range(len(ok)) if k != i), key=key(a))
        for p in [k for k in order if ok[k][1] == a[1]][:5]:
            ps = score(a, ok[p])
            hard = [k for k in order if ok[k][1] != a[1] and 50 * ps <= 100 * score(a, ok[k]) <= 95 * ps][:3]
            out += [(a[0], ok[p][0], j + 1, ok[k][0], ps, score(a, ok[k])) for j, k in enumerate(hard)]
    return sorted(out, key=str)


def mined(spark, rows) -> list[tuple]:
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in hn.mine(df).collect()), key=str)


def test_hilbert_curve_visits_each_cell_once_and_steps_to_neighbours():
    for axes, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        place = hn.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        walk = cells[np.argsort(place)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_score_of_a_box():
    rng = np.random.default_rng(1)
    x, a = rng.integers(-50, 50, (40, 6)), rng.integers(-50, 50, (10, 6))
    least, most = hn._bounds(a, x.min(axis=0)[None], x.max(axis=0)[None])
    scores = a @ x.T
    assert (least[:, 0] <= scores.min(axis=1)).all() and (most[:, 0] >= scores.max(axis=1)).all()


def test_like_a_search_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(hn, "write_blocks", lambda rows, f=hn.write_blocks: f(rows, chunk=64, block=16))
    monkeypatch.setattr(hn, "BLOCK", 16)
    rng = random.Random(5)
    rows = [(i, rng.randrange(4), [rng.randrange(-40, 60) for _ in range(5)], i % 10 == 0) for i in range(400)]
    rows += [(1000 + i, 1, [30, 30, 30, 30, 30], i % 50 == 0) for i in range(150)]  # one vector many times
    assert mined(spark, rows) == plain(rows)


def test_nulls_ties_repeats_and_short_vectors(spark):
    rows = [(0, 1, [3, 4], True), (0, 1, [3, 4], True), (5, 1, [3, 4], False), (6, 2, [2, 4], False), (None, 2, [2, 4], False), (7, 2, [4], False),
            (8, None, [9, 9], True), (9, 1, None, True), (10, 1, [0, 0], False), (11, 3, [-3, -4], True), (12, 3, [3, 4], False)]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, []) == []


def test_unsound_components_give_no_vector(spark):
    df = spark.createDataFrame([([0.5, -0.001],), ([float("nan")],), ([float("inf")],), ([1.0, None],), (None,), ([1e30],)], "v array<float>")
    found = [r[0] for r in df.select(hn.whole_vectors("v", 256)).collect()]
    assert found == [[128, -1], None, None, None, None, [hn.LARGEST]]


def test_exact_scores_beyond_narrow_numbers():
    a = np.array([[hn.LARGEST, 1], [3, -7]])
    x = np.array([[hn.LARGEST, 1], [hn.LARGEST - 1, 5]])
    assert hn._scores(a, x).tolist() == (a @ x.T).tolist()


def test_extra_columns(spark):
    rows = [(0, 1, [3, 4], True), (5, 1, [3, 4], False), (6, 2, [2, 4], False)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("chunk", F.lit(1)).withColumn("score", F.lit(2))
    assert [tuple(r) for r in hn.mine(df).collect()] == plain(rows)

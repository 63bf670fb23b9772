import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from helixloom.llm import exact_dedup


def brute(rows):
    groups = {}
    for i, (doc, text) in enumerate(rows):
        sha = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()
        groups.setdefault(sha, []).append((-len(text or ""), doc is None, doc if doc is not None else 0, i))
    out = []
    for sha, members in groups.items():
        best = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), m == best, sha))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


ROWS = [(1, "a b c"), (2, "ab c"), (3, "abc"), (4, "a  bc\n"), (5, None), (6, ""), (7, " \t\x0b"), (8, "é b"), (9, "éb"), (10, "x\x1cy"), (11, "xy"),
        (None, "a b c"), (None, "only"), (12, "tie a"), (13, "tiea "), (14, "same"), (14, "same"), (15, "long " * 5000), (16, "long" * 5000)]


def test_rows_against_brute_force(documents, clash):
    assert result(exact_dedup.annotate(documents(ROWS, clash))) == brute(ROWS)


def test_empty_table(documents):
    assert exact_dedup.annotate(documents([])).count() == 0
    assert exact_dedup.deduplicate(documents([])).count() == 0


def test_many_random_rows(documents):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(12)))) for i in range(3000)]
    assert result(exact_dedup.annotate(documents(rows).repartition(7))) == brute(rows)


def test_full_filter_changes_nothing(documents, monkeypatch):
    # A filter far too small for the table lets every row through and the result stays the same.
    monkeypatch.setattr(exact_dedup, "MAX_BITS", exact_dedup.SEGMENT)
    rows = [(i, f"text {i % 700}") for i in range(20_000)]
    got = exact_dedup.annotate(documents(rows)).agg(F.sum(F.col("kept").cast("int")), F.max("group_size")).first()
    assert tuple(got) == (700, 29)


def test_unique_rows_pass_straight_through(spark, documents):
    rows = documents([(i, f"text {i}") for i in range(2000)] + [(5000, "twin"), (5001, "t win")])
    keys = rows.select(exact_dedup.text_digest("text").alias("digest"))
    bloom = exact_dedup.repeat_filter(keys, 2002)
    assert isinstance(bloom, np.ndarray)
    maybe = rows.select("doc_id", exact_dedup.maybe_repeated(spark, bloom, exact_dedup.text_digest("text")).alias("m")).filter("m")
    ids = {r.doc_id for r in maybe.collect()}
    assert {5000, 5001} <= ids and len(ids) < 300


def test_deduplicate_keeps_columns_and_one_row(documents, clash):
    df = documents(ROWS, clash)
    out = exact_dedup.deduplicate(df)
    assert out.columns == df.columns
    want = sorted((k for k in brute(ROWS) if k[3]), key=repr)
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted((k[0] for k in want), key=repr)


def test_rows_are_judged_as_by_the_two_functions(spark, documents):
    rows = documents([(i, f"text {i % 700} \u00e9" if i % 3 else f"only {i}") for i in range(1500)] + [(2000, ""), (2001, None), (2002, " \n")])
    text = F.coalesce("text", F.lit(""))
    bloom = exact_dedup.repeat_filter(rows.select(exact_dedup.text_digest(text).alias("digest")), 1503)
    one = rows.select("doc_id", exact_dedup._judged(spark, bloom, text).alias("j")).select("doc_id", "j.*").collect()
    digests = rows.select("doc_id", exact_dedup.text_digest(text).alias("digest"))
    two = digests.withColumn("maybe", exact_dedup.maybe_repeated(spark, bloom, F.col("digest"))).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    assert 0 < sum(r.maybe for r in one) < len(one)


def test_one_python_function_a_task(spark, documents):
    """Functions in a row take a Python worker each, which stays when the task is over."""
    plan = exact_dedup.deduplicate(documents([(1, "a"), (2, "a"), (3, "b")]))._jdf.queryExecution().optimizedPlan().toString()
    branches = plan.split("Union", 1)[1].count("ArrowEvalPython")
    assert branches == 2, plan

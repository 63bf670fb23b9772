"""Review history: intervals, reviews of an earlier time, as-of joins."""

from helixloom.operators import reviews as R

EVENTS = "`group` string, dataset string, document long, status string, description string, reviewer string, ts long"


def history(spark, rows):
    return R.review_history(spark.createDataFrame([("lab", "ds", d, s, None, who, ts) for d, s, who, ts in rows], EVENTS))


def spans(df):
    return sorted((r.document, r.valid_from, r.valid_to, r.status, r.reviewer) for r in df.collect())


def test_intervals(spark):
    got = history(spark, [
        (1, "Rejected", "a", 1), (1, "Rejected", "b", 3), (1, "Approved", "b", 5), (1, "Delete", "a", 8), (1, "Rejected", "c", 9),
        (2, "Rejected", "a", 4), (2, "Approved", "b", 4), (2, "Rejected", "z", 6), (2, "Approved", "q", 6),
        (3, "Delete", "a", 1), (None, "Rejected", "a", 1), (4, "Rejected", "a", None)])
    assert spans(got) == [(1, 1, 5, "Rejected", "a"), (1, 5, 8, "Approved", "b"), (1, 9, None, "Rejected", "c"), (2, 4, None, "Rejected", "a")]
    assert spans(history(spark, [])) == []
    # An executed adaptive plan prints the final plan and the initial one; the latter counts.
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Window [") == 3 and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_rejections_of_an_earlier_time(spark):
    past = history(spark, [(1, "Rejected", "a", 10), (1, "Delete", "a", 20), (2, "Approved", "a", 10), (2, "Rejected", "b", 30)])
    docs = spark.range(1, 4).withColumnRenamed("id", "variant_key")
    left = {at: sorted(r[0] for r in R.exclude_rejected(docs, past, "lab", dataset="ds", as_of=at).collect()) for at in (0, 9, 10, 19, 20, 30)}
    assert left == {0: [1, 2, 3], 9: [1, 2, 3], 10: [2, 3], 19: [2, 3], 20: [1, 2, 3], 30: [1, 3]}


def test_reviews_at_the_time_of_rows(spark):
    past = history(spark, [(1, "Rejected", "a", 10), (1, "Delete", "a", 20), (1, "Approved", "b", 30)])
    rows = spark.createDataFrame([(1, 9), (1, 10), (1, 10), (1, 20), (1, 99), (2, 15), (None, 15), (1, None)], "k long, t long")
    got = [(r.k, r.t, r.status, r.reviewer) for r in R.review_at(rows, past, "lab", "ds", "k", "t").collect()]
    assert sorted(got, key=str) == sorted([(1, 9, None, None), (1, 10, "Rejected", "a"), (1, 10, "Rejected", "a"), (1, 20, None, None),
                                           (1, 99, "Approved", "b"), (2, 15, None, None), (None, 15, None, None), (1, None, None, None)], key=str)
    assert R.review_at(rows, past, "clinic", "ds", "k", "t").filter("status is not null").count() == 0

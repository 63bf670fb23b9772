"""Both layouts agree, hot keys stay exact, and plans are the intended ones."""

import random

import pytest
from pyspark.sql import functions as F

from helixloom.operators import facets as G
from helixloom.operators import otu as O
from helixloom.operators import predicates as P
from helixloom.operators import shaping as S
from helixloom.operators.indexing import global_index
from helixloom.functions.parsers import map_values
from helixloom.operators.nesting import nest, nest_in_parts, unnest
from helixloom.plans.spec import Attribute, FieldFilter, QuerySpec, run_spec, run_spec_nested
from helixloom.sources.warehouse import Tables, load_bucketed, save_bucketed
from workloads.derive import order_tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """One document owns a third of all elements, many of them copies of each other."""
    rng = random.Random(3)
    rows = [(0 if i % 3 == 0 else rng.randrange(1, 40), rng.choice("RAN"), rng.randrange(1, 6) if i % 2 else 1, rng.choice([None, "x", "y"])) for i in range(3000)]
    base = spark.createDataFrame([(k, k % 5, f"d{k}") for k in range(45)], "variant_key int, size int, name string")
    return base, spark.createDataFrame(rows, "variant_key int, flag string, n int, tag string")


SPECS = [
    QuerySpec([Attribute("name"), Attribute("flag", "e"), Attribute("n", "e")], [FieldFilter("nested_filter_terms", "flag", "R\nA", path="e"),
              FieldFilter("nested_filter_range_gte", "n", "3", path="e")], limit=None),
    QuerySpec([Attribute("name"), Attribute("tag", "e")], [FieldFilter("filter_range_lt", "size", "3")], limit=None),
    QuerySpec([Attribute("name")], [FieldFilter("nested_filter_exists", "tag", "only", path="e"), FieldFilter("filter_term", "size", ["2"])], limit=None),
    QuerySpec([Attribute("flag", "e"), Attribute("name")], [FieldFilter("nested_filter_term", "tag", "x", path="e")], limit=7),
]


@pytest.mark.parametrize("i", range(len(SPECS)))
def test_layouts_agree(skewed, i):
    base, rows = skewed
    docs = base.join(nest(rows, ["variant_key"], "e", ["flag", "n", "tag"]), "variant_key", "left")
    a = sorted(map(str, run_spec(Tables(base, {"e": rows}), SPECS[i]).collect()))
    assert a == sorted(map(str, run_spec_nested(docs, SPECS[i]).collect())) and a


def test_nest_in_parts_keeps_every_copy(skewed):
    _, rows = skewed
    docs = nest_in_parts(rows, ["variant_key"], "e", ["flag", "n", "tag"], 20)
    assert docs.columns == ["variant_key", "part", "e"]
    assert docs.agg(F.max(F.size("e"))).first()[0] < 250 and docs.count() > docs.select("variant_key").distinct().count()
    assert sorted(map(str, unnest(docs, ["variant_key"], "e").collect())) == sorted(map(str, rows.collect()))


def test_flatten_collision_and_empty_rules(spark):
    df = spark.sql("""SELECT 1 AS k, 'flat' AS v, array(struct('a' AS v, 1 AS x), struct(cast(null AS string) AS v, 2 AS x)) AS p, array(struct('b' AS v)) AS q
                      UNION ALL SELECT 2, 'flat', array(struct('a' AS v, 1 AS x)), cast(array() AS array<struct<v:string>>)
                      UNION ALL SELECT 3, 'flat', array(struct(cast(null AS string) AS v, 3 AS x)), cast(null AS array<struct<v:string>>)""")
    got = sorted((r["k"], r["v"], r["x"]) for r in S.flatten(df.filter("k <> 2"), "k", ["p", "q"], ["v"]).collect())
    assert got == [(1, "b", 1), (1, "b", 2), (3, "flat", 3)]  # a later path wins, a missing member leaves the flat field
    empty = S.flatten(df.filter("k = 2"), "k", ["p", "q"], ["v"]).first()
    assert empty["x"] is None and empty["v"] == "flat"
    base = df.select("k", "v")
    long = S.flatten_long(base.filter("k <> 2"), "k", {"p": df.select("k", F.explode("p").alias("e")).select("k", "e.*"),
                                                       "q": df.select("k", F.explode("q").alias("e")).select("k", "e.*")}, {"p": ["v", "x"], "q": ["v"]}, ["v"])
    assert sorted((r["k"], r["v"], r["x"]) for r in long.collect()) == got


def test_negated_nested_test_is_never_null(spark):
    df = spark.sql("SELECT 1 AS k, cast(null AS array<struct<f:string>>) AS p UNION ALL SELECT 2, array(struct(cast(null AS string) AS f))")
    test = P.same_element([P.nested_term("p", "f", "a")])
    assert df.filter(test).count() == 0 and df.filter(~test).count() == 2


def test_matching_elements_cap(skewed):
    base, rows = skewed
    docs = nest(rows, ["variant_key"], "e", ["flag", "n"])
    cut = S.matching_elements(docs, "e", [P.nested_term("e", "flag", "R")], ["flag"], cap=100)
    assert cut.agg(F.max(F.size("e"))).first()[0] == 100


def test_nested_filters_reach_the_scan(spark, sf):
    t = order_tables(spark, sf)
    out = run_spec(t, QuerySpec([Attribute("o_orderstatus"), Attribute("l_quantity", "line")], [
        FieldFilter("nested_filter_range_gte", "l_quantity", "30", path="line"), FieldFilter("filter_range_gte", "o_custkey", "5")], limit=None))
    p = plan(out)
    assert "GreaterThanOrEqual(l_quantity,30.0)" in p and "GreaterThanOrEqual(o_custkey,5)" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p and "CartesianProduct" not in p and "NestedLoop" not in p


def test_bucketed_tables_join_without_shuffle(spark, skewed):
    base, rows = skewed
    spark.sql("CREATE DATABASE IF NOT EXISTS bucketed_test")
    try:
        save_bucketed(Tables(base, {"e": rows}), "bucketed_test", 4)
        t = load_bucketed(spark, "bucketed_test", ["e"])
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            joined = t.base.join(t.paths["e"], "variant_key")
            assert joined.count() == rows.count() and "Exchange" not in plan(joined.select("name", "flag"))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    finally:
        spark.sql("DROP DATABASE bucketed_test CASCADE")


def test_facets_are_exact_beyond_the_slices(spark):
    df = spark.range(20000).select((F.col("id") % 5000).cast("string").alias("v"), F.lit("same").alias("w"))
    got = G.facets(df, ["v", "w"], top=100).collect()
    v = [r for r in got if r["field"] == "v"]
    # All counts are equal, so the smallest texts are chosen, and shown in natural order.
    want = sorted(sorted(str(i) for i in range(5000))[:100], key=int)
    assert [r["value"] for r in sorted(v, key=lambda r: r["position"])] == want and {r["n"] for r in v} == {4}
    assert [r["value"] for r in got if r["field"] == "w"] == ["same"]


def test_facet_drops_falsy_values(spark):
    df = spark.sql("SELECT * FROM VALUES ('', 0), ('a', 1), (null, 1) AS t(s, n)")
    assert [r["value"] for r in G.facet(df, "s").collect()] == ["a"] and [r["value"] for r in G.facet(df, "n").collect()] == [1]


def test_global_index_is_dense_and_ordered(spark):
    df = spark.range(5000).select(F.concat(F.lit("k__Bacteria;p__"), F.sha2(F.col("id").cast("string"), 224)).alias("t"))
    rows = global_index(df, "t", "i").collect()
    assert [r["t"] for r in sorted(rows, key=lambda r: r["i"])] == sorted(r["t"] for r in rows) and sorted(r["i"] for r in rows) == list(range(5000))


def test_otu_rules(spark):
    df = spark.createDataFrame([("t1", "s2", 5.0, 1), ("t1", "s2", 7.0, 2), ("t0", "s1", 1.0, 1)], "taxonomy string, BMlabid string, value double, seq int")
    assert O.sample_ids(df, "BMlabid") == ["s1", "s2"]
    got = [tuple(r) for r in O.otu_table(df, ["s1", "s2"], order="seq").orderBy("OTU_ID").collect()]
    assert got == [("OTU_0", 1.0, 0.0, "t0"), ("OTU_1", 0.0, 7.0, "t1")]
    assert O.otu_table(df, ["s1", "s2"], agg="sum").filter("taxonomy = 't1'").first()["s2"] == 12.0
    with pytest.raises(Exception, match="sample without a column: s1"):
        O.otu_table(df, ["s2"], agg="sum").collect()
    for wrong in ({"agg": "last"}, {"agg": "mean"}):
        with pytest.raises(ValueError):
            O.otu_table(df, ["s1", "s2"], **wrong)


def test_nest_keeps_one_row_per_key(spark):
    """Searches by kindred, facets and caps count documents, so a document is one row whatever its size."""
    rows = spark.range(4).select(F.lit(1).alias("variant_key"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("Family_ID"))
    docs = nest(rows, ["variant_key"], "sample", ["Family_ID"]).withColumn("kind", F.lit("SNV"))
    assert docs.count() == 1
    assert run_spec_nested(docs, QuerySpec([Attribute("kind")], kindred=3)).count() == 1
    assert [r["n"] for r in G.facet(docs, "kind").collect()] == [1]


def test_no_silent_limits(spark):
    df = spark.range(40_000).select((F.col("id") + 1).alias("v"))
    assert G.facet(df, "v").count() == 40_000 and QuerySpec([]).limit is None
    table = {f"k{i}": f"v{i}" for i in range(2000)}
    got = spark.createDataFrame([("k1999",), ("other",)], "c string").select(map_values("c", table).alias("c")).collect()
    assert [r["c"] for r in got] == ["v1999", "other"]


def test_nested_range_keeps_missing_where_asked(spark):
    base = spark.createDataFrame([(1,), (2,)], "variant_key int")
    rows = spark.createDataFrame([(1, None), (2, 50)], "variant_key int, DP int")
    keep = FieldFilter("nested_filter_range_lte", "DP", "20", path="e", missing="keep")
    assert [r["variant_key"] for r in run_spec(Tables(base, {"e": rows}), QuerySpec([Attribute("DP", "e")], [keep])).collect()] == [1]


def test_attributes_of_one_name_give_one_column(spark):
    base = spark.createDataFrame([(1, 9)], "variant_key int, DP int")
    rows = spark.createDataFrame([(1, 50)], "variant_key int, DP int")
    out = run_spec(Tables(base, {"e": rows}), QuerySpec([Attribute("DP"), Attribute("DP", "e", "Depth")]))
    assert out.columns == ["variant_key", "Depth"] and out.first()["Depth"] == 50

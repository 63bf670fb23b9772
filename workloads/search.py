"""Filters, shaping, facets and specs over orders with their line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.functions.scalars import natural_key, tokens
from helixloom.operators import facets as G
from helixloom.operators import predicates as P
from helixloom.operators import shaping as S
from helixloom.operators.nesting import nest, nest_in_parts, unnest
from helixloom.plans.spec import Attribute, FieldFilter, QuerySpec, run_spec, run_spec_nested
from helixloom.sources.warehouse import Tables, get_variant
from workloads.derive import nested_orders, order_tables, table
from workloads.registry import query

# --- flat predicates -----------------------------------------------------------------------


def _orders(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    return table(spark, sf, "orders")


@query("term", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf):
    return _orders(spark, sf).filter(P.term("o_orderstatus", "F")).select("o_orderkey", "o_totalprice")


@query("term_all_values", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'")
def _(spark, sf):
    tagged = _orders(spark, sf).select("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("tags"))
    return tagged.filter(P.term("tags", ["F", "5-LOW"], array=True)).select("o_orderkey")


@query("terms", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(spark, sf):
    return _orders(spark, sf).filter(P.terms("o_orderpriority", ["1-URGENT", "2-HIGH"])).select("o_orderkey", "o_orderpriority")


@query("terms_array", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT'")
def _(spark, sf):
    tagged = _orders(spark, sf).select("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("tags"))
    return tagged.filter(P.terms("tags", ["P", "1-URGENT"], array=True)).select("o_orderkey")


@query("range_gt", "SELECT p_partkey FROM part WHERE p_size > 25")
def _(spark, sf):
    return table(spark, sf, "part").filter(P.gt("p_size", 25)).select("p_partkey")


@query("range_gte", "SELECT p_partkey FROM part WHERE p_size >= 25")
def _(spark, sf):
    return table(spark, sf, "part").filter(P.gte("p_size", 25)).select("p_partkey")


_FREQUENCY = "CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END"


@query("range_lt_missing_dropped", f"SELECT p_partkey FROM part WHERE {_FREQUENCY} < 20")
def _(spark, sf):
    freq = F.when(F.col("p_size") % 7 != 0, F.col("p_size"))
    return table(spark, sf, "part").filter(P.lt(freq, 20)).select("p_partkey")


@query("range_lt_missing_kept", f"SELECT p_partkey FROM part WHERE {_FREQUENCY} < 20 OR {_FREQUENCY} IS NULL")
def _(spark, sf):
    freq = F.when(F.col("p_size") % 7 != 0, F.col("p_size"))
    return table(spark, sf, "part").filter(P.lt(freq, 20, missing="keep")).select("p_partkey")


@query("range_lte", "SELECT p_partkey FROM part WHERE p_retailprice <= 950.0")
def _(spark, sf):
    return table(spark, sf, "part").filter(P.lte("p_retailprice", 950.0)).select("p_partkey")


_PRIORITY = "nullif(o_orderpriority, '5-LOW')"


@query("exists_only", f"SELECT o_orderkey FROM orders WHERE {_PRIORITY} IS NOT NULL")
def _(spark, sf):
    return _orders(spark, sf).filter(P.exists(F.nullif("o_orderpriority", F.lit("5-LOW")), "only")).select("o_orderkey")


@query("exists_excluded", f"SELECT o_orderkey FROM orders WHERE {_PRIORITY} IS NULL")
def _(spark, sf):
    return _orders(spark, sf).filter(P.exists(F.nullif("o_orderpriority", F.lit("5-LOW")), "excluded")).select("o_orderkey")


@query("must_not_exist", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    labelled = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return labelled.filter(P.missing("quality")).select("doc_id")


@query("wildcard", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '^Customer#0000.*1.$')")
def _(spark, sf):
    return table(spark, sf, "customer").filter(P.wildcard("c_name", "Customer#0000*1?")).select("c_custkey", "c_name")


@query("must_not_terms", f"SELECT o_orderkey FROM orders WHERE {_PRIORITY} IS NULL OR {_PRIORITY} NOT IN ('1-URGENT', '2-HIGH')")
def _(spark, sf):
    masked = F.nullif("o_orderpriority", F.lit("5-LOW"))
    return _orders(spark, sf).filter(P.not_terms(masked, ["1-URGENT", "2-HIGH"])).select("o_orderkey")


@query("any_of", "SELECT p_partkey FROM part WHERE p_type = 'PROMO' OR p_brand IN ('Brand#1', 'Brand#2') OR p_size > 45")
def _(spark, sf):
    test = P.any_of(P.term("p_type", "PROMO"), P.terms("p_brand", ["Brand#1", "Brand#2"]), P.gt("p_size", 45))
    return table(spark, sf, "part").filter(test).select("p_partkey")


@query("outside_range", "SELECT p_partkey, p_size FROM part WHERE p_size <= 10 OR p_size >= 40")
def _(spark, sf):
    return table(spark, sf, "part").filter(P.outside("p_size", 10, 40)).select("p_partkey", "p_size")


@query("text_term", r"SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\p{L}]+'), 'the')")
def _(spark, sf):
    return table(spark, sf, "documents").filter(P.text_term("text", "The")).select("doc_id")


@query("text_term_whitespace", r"SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), 'The')")
def _(spark, sf):
    return table(spark, sf, "documents").filter(P.text_term("text", "The", "whitespace")).select("doc_id")


@query("all_of", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 200000 AND o_orderpriority <> '1-URGENT'")
def _(spark, sf):
    test = P.all_of(P.term("o_orderstatus", "O"), P.gte("o_totalprice", 200000.0), P.not_terms("o_orderpriority", ["1-URGENT"]))
    return _orders(spark, sf).filter(test).select("o_orderkey")


# --- nested predicates ---------------------------------------------------------------------


def _owners(spark: SparkSession, sf: str, *preds: P.Nested) -> DataFrame:
    t = order_tables(spark, sf)
    return P.with_element(t.base, t.paths["line"], t.key, list(preds)).select("o_orderkey", "o_orderstatus")


def _owners_sql(test: str) -> str:
    return ("SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS "
            f"(SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {test})")


@query("nested_term", _owners_sql("l_returnflag = 'R'"))
def _(spark, sf):
    return _owners(spark, sf, P.nested_term("line", "l_returnflag", "R"))


@query("nested_terms", _owners_sql("l_linenumber IN (6, 7)"))
def _(spark, sf):
    return _owners(spark, sf, P.nested_terms("line", "l_linenumber", [6, 7]))


@query("nested_terms_split", _owners_sql("l_returnflag IN ('R', 'A')"))
def _(spark, sf):
    return _owners(spark, sf, P.nested_terms("line", "l_returnflag", ["R A"], split_ws=True))


@query("nested_range_gte", _owners_sql("l_quantity >= 49"))
def _(spark, sf):
    return _owners(spark, sf, P.nested_gte("line", "l_quantity", 49.0))


@query("nested_range_lte", _owners_sql("l_discount <= 0.01"))
def _(spark, sf):
    return _owners(spark, sf, P.nested_lte("line", "l_discount", 0.01))


@query("nested_exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND nullif(l_returnflag, 'N') IS NOT NULL)")
def _(spark, sf):
    t = order_tables(spark, sf)
    rows = t.paths["line"].select("o_orderkey", F.nullif("l_returnflag", F.lit("N")).alias("returned"))
    return P.with_element(t.base, rows, t.key, [P.nested_exists("line", "returned")]).select("o_orderkey")


@query("nested_wildcard", """SELECT conv_id FROM conversations WHERE role LIKE 'a%t' GROUP BY conv_id""")
def _(spark, sf):
    rows = table(spark, sf, "conversations")
    return P.with_element(rows.select("conv_id").distinct(), rows, "conv_id", [P.nested_wildcard("turn", "role", "a*t")])


_SAME = "l_returnflag IN ('R', 'A') AND l_quantity >= 45 AND l_discount <= 0.02"


@query("same_element_long", _owners_sql(_SAME))
def _(spark, sf):
    return _owners(spark, sf, P.nested_terms("line", "l_returnflag", ["R", "A"]), P.nested_gte("line", "l_quantity", 45.0),
                   P.nested_lte("line", "l_discount", 0.02))


@query("same_element_arrays", _owners_sql(_SAME))
def _(spark, sf):
    docs = nested_orders(spark, sf, ["l_returnflag", "l_quantity", "l_discount"])
    test = P.same_element([P.nested_terms("line", "l_returnflag", ["R", "A"]), P.nested_gte("line", "l_quantity", 45.0),
                           P.nested_lte("line", "l_discount", 0.02)])
    # A very large document takes several rows of one key, hence the distinct; it needs no further shuffle.
    return docs.filter(test).select("o_orderkey", "o_orderstatus").dropDuplicates(["o_orderkey"])


@query("nested_analysed_text", r"""SELECT conv_id FROM conversations WHERE list_contains(regexp_split_to_array(lower(text), '[^\p{L}]+'), 'the')
 AND role = 'user' GROUP BY conv_id""")
def _(spark, sf):
    rows = table(spark, sf, "conversations")
    preds = [P.nested_term("turn", "text", "The", analyzer="simple"), P.nested_term("turn", "role", "user")]
    return P.with_element(rows.select("conv_id").distinct(), rows, "conv_id", preds)


# --- documents from rows -------------------------------------------------------------------


@query("nest", """SELECT conv_id, count(*)::INT AS turns, string_agg(turn || ':' || role, ',' ORDER BY turn, role) AS roles
 FROM conversations GROUP BY conv_id""")
def _(spark, sf):
    docs = nest(table(spark, sf, "conversations"), ["conv_id"], "turn", ["turn", "role"])
    text = F.array_join(F.transform("turn", lambda e: F.concat(e["turn"].cast("string"), F.lit(":"), e["role"])), ",")
    return docs.select("conv_id", F.size("turn").alias("turns"), text.alias("roles"))


@query("nest_in_parts", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def _(spark, sf):
    parts = nest_in_parts(table(spark, sf, "orders"), ["o_custkey"], "order", ["o_orderkey", "o_totalprice"], 4)
    return unnest(parts, ["o_custkey"], "order")


# --- shaping -------------------------------------------------------------------------------


@query("select_attributes", """SELECT o_orderstatus, o_orderkey, l_linenumber, l_returnflag FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def _(spark, sf):
    docs = nested_orders(spark, sf, ["l_linenumber", "l_returnflag", "l_quantity"])
    cut = S.select_attributes(docs, ["o_orderstatus", "o_orderkey", "line.l_linenumber", "line.l_returnflag"])
    return cut.select("o_orderstatus", "o_orderkey", F.explode_outer("line").alias("e")).select("o_orderstatus", "o_orderkey", "e.*")


@query("matching_elements", """SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity >= 40""")
def _(spark, sf):
    docs = nested_orders(spark, sf, ["l_linenumber", "l_returnflag", "l_quantity"])
    preds = [P.nested_term("line", "l_returnflag", "R"), P.nested_gte("line", "l_quantity", 40.0)]
    hits = S.matching_elements(docs.filter(P.same_element(preds)), "line", preds, ["l_linenumber", "l_quantity"])
    return unnest(hits, ["o_orderkey"], "line")


_FLAT = """SELECT DISTINCT o_orderkey, o_orderstatus, l_linenumber, l_returnflag FROM orders
 LEFT JOIN lineitem ON l_orderkey = o_orderkey"""


@query("flatten_arrays", _FLAT)
def _(spark, sf):
    docs = nested_orders(spark, sf, ["l_linenumber", "l_returnflag"])
    return S.flatten(docs, "o_orderkey", ["line"], ["o_orderstatus"])


@query("flatten_long", _FLAT)
def _(spark, sf):
    t = order_tables(spark, sf)
    return S.flatten_long(t.base, t.key, t.paths, {"line": ["l_linenumber", "l_returnflag"]}, ["o_orderstatus"])


# Two paths: a customer's large orders and the customer's purchases.
_TWO_PATHS = """SELECT c.c_custkey, c.c_mktsegment, o.o_orderkey, o.o_orderstatus, e.event_id, e.event_type FROM customer c
 JOIN (SELECT DISTINCT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_totalprice >= 400000) o ON o.o_custkey = c.c_custkey
 LEFT JOIN (SELECT DISTINCT user_id, event_id, event_type FROM events) e ON e.user_id = c.c_custkey"""


def _customers(spark: SparkSession, sf: str) -> Tables:
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    events = table(spark, sf, "events").withColumnRenamed("user_id", "c_custkey")
    return Tables(table(spark, sf, "customer"), {"order": orders, "event": events}, "c_custkey")


_TWO_FIELDS = {"order": ["o_orderkey", "o_orderstatus"], "event": ["event_id", "event_type"]}
_LARGE = [P.nested_gte("order", "o_totalprice", 400000.0)]


@query("flatten_two_paths_long", _TWO_PATHS)
def _(spark, sf):
    t = _customers(spark, sf)
    return S.flatten_long(t.base, t.key, t.paths, _TWO_FIELDS, ["c_mktsegment"], _LARGE)


@query("flatten_two_paths_arrays", _TWO_PATHS)
def _(spark, sf):
    t = _customers(spark, sf)
    docs = t.base
    for p, fields in {"order": ["o_orderkey", "o_orderstatus", "o_totalprice"], "event": ["event_id", "event_type"]}.items():
        docs = docs.join(nest(t.paths[p], ["c_custkey"], p, fields), "c_custkey", "left")
    docs = S.matching_elements(docs.filter(P.same_element(_LARGE)), "order", _LARGE, _TWO_FIELDS["order"])
    return S.flatten(docs, "c_custkey", ["order", "event"], ["c_mktsegment"])


@query("flatten_empty_product", """SELECT o_orderkey, NULL::INT AS l_linenumber, NULL::VARCHAR AS p_brand FROM orders
 WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 45)
 UNION ALL SELECT DISTINCT a.l_orderkey, a.l_linenumber, p_brand FROM lineitem a JOIN
 (SELECT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 45) b ON a.l_orderkey = b.l_orderkey
 WHERE a.l_orderkey IN (SELECT o_orderkey FROM orders)""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    parts = lines.join(table(spark, sf, "part").filter("p_size > 45"), F.col("p_partkey") == F.col("l_partkey"))
    docs = nested_orders(spark, sf, ["l_linenumber"]).join(nest(parts, ["o_orderkey"], "part", ["p_brand"]), "o_orderkey", "left")
    # A present but empty array makes the whole product empty.
    docs = docs.withColumn("part", F.coalesce("part", F.array().cast("array<struct<p_brand:string>>")))
    return S.flatten(docs, "o_orderkey", ["line", "part"])


@query("flatten_carried_field", """SELECT DISTINCT o_orderkey, o_orderstatus || ';' || o_orderpriority AS tags, l_linenumber FROM orders
 LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def _(spark, sf):
    docs = nested_orders(spark, sf, ["l_linenumber"]).withColumn("FILTER", F.array("o_orderstatus", "o_orderpriority"))
    flat = S.flatten(docs, "o_orderkey", ["line"], skip=["FILTER"])
    return flat.select("o_orderkey", F.array_join("FILTER", ";").alias("tags"), "l_linenumber")


@query("limit_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 400")
def _(spark, sf):
    return S.limit_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 400, [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("label_columns", """SELECT p_partkey AS "Part", p_brand AS "Gene symbol", p_size FROM part""")
def _(spark, sf):
    return S.label_columns(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), {"p_partkey": "Part", "p_brand": "Gene symbol"})


@query("stringify", f"""SELECT o_orderkey::VARCHAR AS o_orderkey, coalesce({_PRIORITY}, 'None') AS priority, '["' || o_orderstatus || '"]' AS tags FROM orders""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), F.array("o_orderstatus").alias("tags"))
    return S.stringify(df)


@query("nonempty_groups", f"""SELECT o_orderkey, concat_ws(',', CASE WHEN {_PRIORITY} IS NOT NULL OR nullif(o_orderstatus, 'P') IS NOT NULL THEN 'state' END,
 CASE WHEN o_totalprice <> 0 THEN 'money' END) AS panels FROM orders""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
                                           F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    out = S.nonempty_groups(df, {"state": ["priority", "status"], "money": ["o_totalprice", "absent"]})
    return out.select("o_orderkey", F.array_join("panels", ",").alias("panels"))


@query("terms_file", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, sf):
    ids = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("value"))
    return S.terms_file(table(spark, sf, "orders"), "o_custkey", ids).select("o_orderkey", "o_custkey")


@query("terms_file_array", r"""WITH ids AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS w FROM benchmark) WHERE length(w) >= 12)
 SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS w FROM documents) WHERE w IN (SELECT w FROM ids)""")
def _(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(tokens("text")).alias("value")).filter(F.length("value") >= 12)
    docs = table(spark, sf, "documents").select("doc_id", tokens("text").alias("words"))
    return S.terms_file(docs, "words", words, key="doc_id").select("doc_id")


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(spark, sf):
    from helixloom.operators.merging import distinct_rows

    return distinct_rows(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


@query("get_document", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def _(spark, sf):
    return get_variant(table(spark, sf, "orders"), 77, "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


# --- facets --------------------------------------------------------------------------------

_NATURAL = "regexp_extract({c}, '^(\\D*)', 1), coalesce(try_cast(regexp_extract({c}, '(\\d+)', 1) AS BIGINT), -1), {c}"


@query("facet_flat", f"""SELECT p_brand AS value, count(*) AS n, (row_number() OVER (ORDER BY {_NATURAL.format(c='p_brand')}))::INT AS position
 FROM part GROUP BY p_brand""")
def _(spark, sf):
    return G.facet(table(spark, sf, "part"), "p_brand")


@query("facet_top", """SELECT value, n, (row_number() OVER (ORDER BY value))::INT AS position FROM
 (SELECT o_custkey AS value, count(*) AS n FROM orders WHERE o_custkey <> 0 GROUP BY 1 ORDER BY n DESC, value LIMIT 50)""")
def _(spark, sf):
    return G.facet(table(spark, sf, "orders"), "o_custkey", 50)


@query("facet_nested", """SELECT l_returnflag AS value, count(*) AS n, (row_number() OVER (ORDER BY l_returnflag))::INT AS position
 FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1""")
def _(spark, sf):
    return G.facet(nested_orders(spark, sf, ["l_returnflag"]), "line.l_returnflag")


def _facets_sql(*fields: tuple[str, str, str, str]) -> str:
    parts = [f"SELECT '{f}' AS field, {c}::VARCHAR AS value, count(*) AS n FROM {t} WHERE {w} GROUP BY 2" for f, c, t, w in fields]
    inner = " UNION ALL ".join(parts)
    return f"SELECT field, value, n, (row_number() OVER (PARTITION BY field ORDER BY {_NATURAL.format(c='value')}))::INT AS position FROM ({inner})"


@query("facets_one_pass", _facets_sql(("p_brand", "p_brand", "part", "true"), ("p_type", "p_type", "part", "true"), ("p_size", "p_size", "part", "p_size <> 0")))
def _(spark, sf):
    return G.facets(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"])


@query("facets_long", _facets_sql(("o_orderstatus", "o_orderstatus", "orders", "true"), ("o_orderpriority", "o_orderpriority", "orders", "true"),
                                  ("line.l_returnflag", "l_returnflag", "lineitem", "true"), ("line.l_linestatus", "l_linestatus", "lineitem", "true")))
def _(spark, sf):
    t = order_tables(spark, sf)
    return G.long_facets({"": t.base, **t.paths}, ["o_orderstatus", "o_orderpriority", "line.l_returnflag", "line.l_linestatus"])


@query("natural_sort", """SELECT DISTINCT p_brand, 'Brand#/' || lpad(length(d)::VARCHAR, 6, '0') || d AS sort_key FROM (SELECT p_brand, regexp_extract(p_brand, '(\\d+)', 1) AS d FROM part)""")
def _(spark, sf):
    return table(spark, sf, "part").select("p_brand", F.array_join(natural_key("p_brand"), "/").alias("sort_key")).distinct()


@query("gene_list", """SELECT string_agg(p_brand, '|' ORDER BY p_brand) AS genes FROM (SELECT DISTINCT p_brand FROM part WHERE p_size > 40)""")
def _(spark, sf):
    return G.gene_list(table(spark, sf, "part").filter("p_size > 40"), "p_brand")


# --- specs ---------------------------------------------------------------------------------

SPEC = QuerySpec(
    attributes=[Attribute("o_orderstatus"), Attribute("o_totalprice"), Attribute("l_linenumber", "line"),
                Attribute("l_quantity", "line"), Attribute("l_returnflag", "line")],
    filters=[
        FieldFilter("filter_term", "o_orderstatus", "F"),
        FieldFilter("filter_range_gte", "o_totalprice", "100000"),
        FieldFilter("nested_filter_terms", "l_returnflag", "R\nA", path="line"),
        FieldFilter("nested_filter_range_gte", "l_quantity", "30", path="line"),
        FieldFilter("filter_terms", "o_orderpriority", ""),
    ],
    limit=400,
)
_SPEC_SQL = """SELECT DISTINCT o_orderkey, o_orderstatus, o_totalprice, l_linenumber, l_quantity, l_returnflag FROM orders
 JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND o_totalprice >= 100000
 AND l_returnflag IN ('R', 'A') AND l_quantity >= 30"""
_SPEC_LIMITED = _SPEC_SQL + " ORDER BY o_orderkey, o_orderstatus, o_totalprice, l_linenumber, l_quantity, l_returnflag LIMIT 400"


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return run_spec(order_tables(spark, sf), SPEC)


query("search_spec", _SPEC_LIMITED)(flagship)


@query("search_spec_arrays", _SPEC_LIMITED)
def _(spark, sf):
    return run_spec_nested(nested_orders(spark, sf, ["l_linenumber", "l_quantity", "l_returnflag"]), SPEC, "o_orderkey")


@query("search_spec_export", _SPEC_SQL)
def _(spark, sf):
    return run_spec(order_tables(spark, sf), SPEC, limit=None)


@query("search_spec_replayed", _SPEC_SQL)
def _(spark, sf):
    return run_spec(order_tables(spark, sf), QuerySpec.from_json(SPEC.to_json()), limit=None)


@query("search_filter_only_path", """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice < 50000 AND EXISTS
 (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber <= 1 AND l_returnflag = 'N')""")
def _(spark, sf):
    spec = QuerySpec([Attribute("o_orderstatus")], [
        FieldFilter("filter_range_lt", "o_totalprice", "50000"), FieldFilter("nested_filter_range_lte", "l_linenumber", "1", path="line"),
        FieldFilter("nested_filter_term", "l_returnflag", "N", path="line")], limit=None)
    return run_spec(order_tables(spark, sf), spec)

"""Cohorts merged and audited, curation, saved searches, field plans and taxon tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixloom.operators import merging as M
from helixloom.operators import otu as O
from helixloom.operators import reviews as R
from helixloom.plans.field_plan import field_plan
from helixloom.plans.log import saved_specs
from helixloom.sources.vcf import header_catalog
from workloads import vcf_text as T
from workloads.derive import table
from workloads.registry import query

# Cases are the smaller parts, controls the larger ones; the middle sizes are in both.
_SIDES = """a AS (SELECT p_partkey AS k, p_size AS "AC", p_brand AS gene, p_type AS note FROM part WHERE p_size < 35),
 b AS (SELECT p_partkey AS k, p_size + 1 AS "AC", p_brand || 'x' AS gene, NULL::VARCHAR AS note FROM part WHERE p_size > 12)"""


def _sides(spark, sf):
    part, k = table(spark, sf, "part"), F.col("p_partkey")
    a = part.filter("p_size < 35").select(k.alias("k"), F.col("p_size").alias("AC"), F.col("p_brand").alias("gene"), F.col("p_type").alias("note"),
                                       F.array(F.lit("case1"), F.lit("case2")).alias("sample"))
    b = part.filter("p_size > 12").select(k.alias("k"), (F.col("p_size") + 1).alias("AC"), F.concat("p_brand", F.lit("x")).alias("gene"),
                                       F.lit(None).cast("string").alias("note"), F.array(F.lit("control1")).alias("sample"))
    return a, b


@query("merge_case_control", f"""WITH {_SIDES} SELECT coalesce(a.k, b.k) AS k, a."AC" AS "AC_case", b."AC" AS "AC_control", coalesce(b.gene, a.gene) AS gene, coalesce(b.note, a.note) AS note,
 concat_ws(',', CASE WHEN a.k IS NOT NULL THEN 'case1,case2' END, CASE WHEN b.k IS NOT NULL THEN 'control1' END) AS samples FROM a FULL JOIN b ON a.k = b.k""")
def _(spark, sf):
    merged = M.merge_case_control(*_sides(spark, sf), keys=["k"], arrays=["sample"])
    return merged.select("k", "AC_case", "AC_control", "gene", "note", F.array_join("sample", ",").alias("samples"))


@query("concat_cohorts", f"""WITH {_SIDES} SELECT "group", count(*) AS n, count(note) AS notes FROM (SELECT k, note, 'case' AS "group" FROM a UNION ALL SELECT k, note, 'control' FROM b) GROUP BY 1""")
def _(spark, sf):
    a, b = _sides(spark, sf)
    both = M.concat_cohorts(a.drop("sample"), b.drop("sample", "note"))
    return both.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count("note").alias("notes"))


@query("label_metrics", """SELECT p_partkey, p_size AS "AC_run1", CASE WHEN p_size % 7 <> 0 THEN 'run1=' || p_size END AS dp, 'run1=' || p_type AS filter FROM part""")
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("AC"), F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("DP"), F.col("p_type").alias("FILTER"))
    out = M.label_metrics(df, "run1")

    def shown(name):
        return F.transform(name, lambda e: F.concat_ws("=", e[f"{name}_label"], e[f"{name}_value"].cast("string")))

    return out.select("p_partkey", "AC_run1", F.array_join(shown("DP"), ",").alias("dp"), F.array_join(shown("FILTER"), ",").alias("filter"))


@query("upsert_variants", f"""WITH {_SIDES} SELECT coalesce(a.k, b.k) AS k, coalesce(a.gene, b.gene) AS gene, b."AC" AS "AC_b", a."AC" AS "AC_a",
 concat_ws(',', CASE WHEN a.k IS NOT NULL THEN 'case1,case2' END, CASE WHEN b.k IS NOT NULL THEN 'control1' END) AS samples FROM a FULL JOIN b ON a.k = b.k""")
def _(spark, sf):
    a, b = _sides(spark, sf)
    target, batch = a.withColumnRenamed("AC", "AC_a").drop("note"), b.withColumnRenamed("AC", "AC_b").drop("note")
    out = M.upsert_variants(target, batch, "k", fresh=["AC_b"])
    return out.select("k", "gene", "AC_a", "AC_b", F.array_join("sample", ",").alias("samples"))


@query("upsert_rows", f"""WITH {_SIDES} SELECT k, gene, "AC" FROM b UNION ALL SELECT k, gene, "AC" FROM a WHERE k NOT IN (SELECT k FROM b)""")
def _(spark, sf):
    a, b = _sides(spark, sf)
    return M.upsert_rows(a.select("k", "gene", "AC"), b.select("k", "gene", "AC"), ["k"])


_FILE = """f AS (SELECT l_partkey AS k, count(*) AS lines FROM lineitem WHERE l_quantity > 45 GROUP BY 1), w AS (SELECT p_partkey AS k FROM part WHERE p_size < 30)"""


def _file(spark, sf):
    return (table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("k")),
            table(spark, sf, "part").filter("p_size < 30").select(F.col("p_partkey").alias("k")))


@query("audit_load", f"WITH {_FILE} SELECT k, lines, k IN (SELECT k FROM w) AS found FROM f")
def _(spark, sf):
    return M.audit_load(*_file(spark, sf), ["k"])


@query("missing_variants", f"WITH {_FILE} SELECT k FROM f WHERE k NOT IN (SELECT k FROM w)")
def _(spark, sf):
    return M.missing_variants(*_file(spark, sf), ["k"])


@query("merge_catalogs", """WITH c AS (SELECT p_brand AS name, 'integer' AS type FROM part WHERE p_size < 30 GROUP BY 1), d AS (SELECT p_brand AS name, 'float' AS type FROM part WHERE p_size > 48 GROUP BY 1)
 SELECT name, coalesce(d.type, c.type) AS type FROM c FULL JOIN d USING (name)""")
def _(spark, sf):
    part = table(spark, sf, "part")
    c = part.filter("p_size < 30").select(F.col("p_brand").alias("name"), F.lit("integer").alias("type")).distinct()
    d = part.filter("p_size > 48").select(F.col("p_brand").alias("name"), F.lit("float").alias("type")).distinct()
    return M.merge_catalogs(c, d, ["name"])


@query("catalog_diff", """SELECT DISTINCT 'INFO' AS section, p_type || '_score' AS name FROM part WHERE p_type NOT IN ('PROMO', 'SMALL') UNION ALL SELECT DISTINCT 'INFO', replace(p_brand, '#', '_') FROM part""")
def _(spark, sf):
    declared = header_catalog(T.header(spark, sf)).filter("section = 'INFO'").select("section", "name")
    known = declared.filter(F.col("name").isin("PROMO_score", "SMALL_score"))
    return M.catalog_diff(declared, known)


# --- curation ------------------------------------------------------------------------------

# Labels are reviews of two groups: bad quality or toxic documents are rejected.
_REVIEWS = """r AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'lab' ELSE 'clinic' END AS "group", doc_id AS document,
 CASE WHEN quality = 0 OR toxic = 1 THEN 'Rejected' ELSE 'Approved' END AS status FROM labels)"""


def _reviews(spark, sf):
    return table(spark, sf, "labels").select(
        F.when(F.col("doc_id") % 2 == 0, "lab").otherwise("clinic").alias("group"), F.lit("docs").alias("dataset"), F.col("doc_id").alias("document"),
        F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "Rejected").otherwise("Approved").alias("status"),
        F.lit(None).cast("string").alias("description"), F.lit(0).cast("long").alias("ts"))


@query("exclude_rejected", f"""WITH {_REVIEWS} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT document FROM r WHERE "group" = 'lab' AND status = 'Rejected')""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return R.exclude_rejected(docs, _reviews(spark, sf), "lab", "doc_id", "docs")


@query("exclude_rejected_dataset", f"""WITH {_REVIEWS} SELECT doc_id, source FROM documents
 WHERE doc_id NOT IN (SELECT document FROM r WHERE "group" = 'lab' AND status = 'Rejected' AND document % 4 = 0)""")
def _(spark, sf):
    # Half of the rejections are in another dataset and hide nothing here.
    reviews = _reviews(spark, sf).withColumn("dataset", F.when(F.col("document") % 4 == 0, "docs").otherwise("other"))
    return R.exclude_rejected(table(spark, sf, "documents").select("doc_id", "source"), reviews, "lab", "doc_id", "docs")


# Afterwards the clinic approves what it had rejected, all toxic documents lose their review, and the lab reviews those again.
@query("apply_reviews", """WITH l AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'lab' ELSE 'clinic' END AS "group" FROM labels)
 SELECT "group", doc_id AS document, CASE WHEN toxic = 1 THEN 'Rejected' WHEN "group" = 'clinic' OR quality = 1 THEN 'Approved' ELSE 'Rejected' END AS status
 FROM l WHERE toxic = 0 OR "group" = 'lab'""")
def _(spark, sf):
    base = _reviews(spark, sf)
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("document"))
    approved = base.filter("`group` = 'clinic' and status = 'Rejected'").withColumns({"status": F.lit("Approved"), "ts": F.lit(1).cast("long")})
    gone = base.join(toxic, "document", "left_semi").withColumns({"status": F.lit("Delete"), "ts": F.lit(2).cast("long")})
    again = base.filter("`group` = 'lab'").join(toxic, "document", "left_semi").withColumns({"status": F.lit("Rejected"), "ts": F.lit(3).cast("long")})
    return R.apply_reviews(base, approved.unionByName(gone).unionByName(again)).select("group", "document", "status")


# Events as reviews of users: errors reject, views take reviews back, all else approves. Two events share a time.
_REVIEW_EVENTS = """v AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'clinic' ELSE 'lab' END AS "group", user_id AS document,
  CASE event_type WHEN 'error' THEN 'Rejected' WHEN 'view' THEN 'Delete' ELSE 'Approved' END AS status,
  'curator' || (event_id % 7) AS reviewer, event_id // 2 AS ts FROM events)"""


def _history(spark, sf):
    kind = F.when(F.col("event_type") == "error", "Rejected").when(F.col("event_type") == "view", "Delete").otherwise("Approved")
    return R.review_history(table(spark, sf, "events").select(
        F.when(F.col("event_id") % 3 == 0, "clinic").otherwise("lab").alias("group"), F.lit("users").alias("dataset"), F.col("user_id").alias("document"),
        kind.alias("status"), F.lit(None).cast("string").alias("description"),
        F.concat(F.lit("curator"), F.col("event_id") % 7).alias("reviewer"), F.expr("event_id div 2").alias("ts")))


# A change is an event whose last predecessor at an earlier time had another status.
@query("review_history", f"""WITH {_REVIEW_EVENTS},
 one AS (SELECT "group", document, ts, max(status) AS status, max_by(reviewer, (status, reviewer)) AS reviewer FROM v GROUP BY ALL),
 c AS (SELECT *, lag(status) OVER (PARTITION BY "group", document ORDER BY ts) AS b FROM one),
 d AS (SELECT * FROM c WHERE b IS DISTINCT FROM status)
 SELECT "group", document, status, reviewer, ts AS valid_from, (SELECT min(e.ts) FROM d e WHERE e."group" = d."group" AND e.document = d.document AND e.ts > d.ts) AS valid_to
 FROM d WHERE status <> 'Delete'""")
def _(spark, sf):
    return _history(spark, sf).select("group", "document", "status", "reviewer", "valid_from", "valid_to")


@query("exclude_rejected_as_of", f"""WITH {_REVIEW_EVENTS},
 l AS (SELECT document, max_by(status, (ts, status)) AS status FROM v WHERE "group" = 'lab' AND ts <= 200 GROUP BY document)
 SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT document FROM l WHERE status = 'Rejected')""")
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id")
    return R.exclude_rejected(rows, _history(spark, sf), "lab", "user_id", "users", as_of=200)


@query("review_at_row_time", f"""WITH {_REVIEW_EVENTS},
 one AS (SELECT document, ts, max(status) AS status FROM v WHERE "group" = 'clinic' GROUP BY ALL),
 e AS (SELECT event_id, user_id, event_id // 2 AS ts FROM events)
 SELECT event_id, user_id, nullif(status, 'Delete') AS status FROM e ASOF LEFT JOIN one ON e.user_id = one.document AND e.ts >= one.ts""")
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", F.expr("event_id div 2").alias("at"))
    return R.review_at(rows, _history(spark, sf), "clinic", "users", "user_id", "at").select("event_id", "user_id", "status")


@query("reviews_for_groups", f"""WITH {_REVIEWS} SELECT document, status FROM r WHERE "group" IN ('clinic')""")
def _(spark, sf):
    return R.reviews_for(_reviews(spark, sf), ["clinic"]).select("document", "status")


@query("saved_specs", """SELECT 'q' || c_custkey AS id, c_name AS name, 'p_size' AS field, 'Part size' AS display_text, 'filter_range_gte' AS kind, (c_custkey % 50)::VARCHAR AS value
 FROM customer WHERE c_nationkey = 3""")
def _(spark, sf):
    spec = F.format_string('{"attributes": [], "filters": [{"kind": "filter_range_gte", "field": "p_size", "path": null, "value": "%s"}]}', F.col("c_custkey") % 50)
    log = table(spark, sf, "customer").select(T.text("q", F.col("c_custkey")).alias("id"), T.text("u", F.col("c_nationkey")).alias("user"),
                                              F.lit("parts").alias("dataset"), F.col("c_name").alias("name"), spec.alias("spec"))
    catalog = spark.sql("SELECT 'p_size' AS field, cast(NULL AS string) AS path, 'Part size' AS display_text")
    return saved_specs(log, "u3", catalog).select("id", "name", "field", "display_text", "kind", "value")


@query("field_plan", """SELECT field, panel, sub_panel, kind, choices FROM (
 SELECT DISTINCT p_type || '_score' AS field, 'Pathogenicity Predictions' AS panel, 'Scores' AS sub_panel, 'filter_range_gte' AS kind, false AS choices FROM part
 UNION ALL SELECT DISTINCT replace(p_brand, '#', '_'), 'Other', '', unnest(['filter_range_gte', 'filter_range_lte']), false FROM part
 UNION ALL SELECT DISTINCT 'gnomAD_' || p_type || '_AF', 'Minor Allele Frequency (MAF)', 'gnomAD', 'filter_range_lt', false FROM part
 UNION ALL SELECT 'PL' || r_regionkey, 'Sample Related Information', '', 'nested_filter_range_gte', false FROM region)""")
def _(spark, sf):
    declared = header_catalog(T.header(spark, sf)).filter("section in ('INFO', 'FORMAT')")
    path = F.when(F.col("section") == "FORMAT", "sample")
    catalog = declared.select(F.col("name").alias("field"), path.alias("path"), "type")
    freq = table(spark, sf, "part").select(T.text("gnomAD_", F.col("p_type"), "_AF").alias("field"), F.lit(None).cast("string").alias("path"), F.lit("float").alias("type")).distinct()
    return field_plan(catalog.unionByName(freq)).select("field", "panel", "sub_panel", "kind", "choices")


# --- taxon tables --------------------------------------------------------------------------

_CELLS = """c AS (SELECT p_type || ';' || p_brand AS taxonomy, n_name AS sample, l_quantity AS value, l_orderkey * 1000 + l_linenumber * 100 + l_quantity AS seq
 FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
 last AS (SELECT taxonomy, sample, arg_max(value, seq) AS value FROM c GROUP BY ALL),
 ids AS (SELECT taxonomy, 'OTU_' || (row_number() OVER (ORDER BY taxonomy) - 1) AS "OTU_ID" FROM (SELECT DISTINCT taxonomy FROM c))"""


def _cells(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity")).alias("seq"))
    part = table(spark, sf, "part").select("p_partkey", F.concat_ws(";", "p_type", "p_brand").alias("taxonomy"))
    nation = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("BMlabid"))
    return (lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(nation, F.col("l_suppkey") == F.col("s_suppkey"))
            .select("taxonomy", "BMlabid", F.col("l_quantity").alias("value"), "seq"))


NATIONS = [f"NATION_{i}" for i in range(25)]  # for the SQL; the queries read the headings from the data


@query("otu_table", f"WITH {_CELLS} SELECT \"OTU_ID\", ids.taxonomy, " + ", ".join(f"coalesce(max(CASE WHEN sample = '{n}' THEN value END), 0) AS \"{n}\"" for n in NATIONS)
       + " FROM last JOIN ids USING (taxonomy) GROUP BY ALL")
def _(spark, sf):
    return O.otu_table(_cells(spark, sf), O.sample_ids(table(spark, sf, "nation"), "n_name"), order="seq")


@query("otu_table_sum", f"WITH {_CELLS} SELECT \"OTU_ID\", ids.taxonomy, " + ", ".join(f"coalesce(sum(CASE WHEN sample = '{n}' THEN value END), 0) AS \"{n}\"" for n in NATIONS)
       + " FROM c JOIN ids USING (taxonomy) GROUP BY ALL")
def _(spark, sf):
    return O.otu_table(_cells(spark, sf), O.sample_ids(table(spark, sf, "nation"), "n_name"), agg="sum")


@query("otu_long", f"WITH {_CELLS} SELECT \"OTU_ID\", taxonomy, sample AS \"BMlabid\", value FROM last JOIN ids USING (taxonomy)")
def _(spark, sf):
    return O.otu_long(_cells(spark, sf), order="seq")

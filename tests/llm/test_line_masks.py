"""Masked lines of the line dedup."""

import re

from pyspark.sql import functions as F

from helixloom.llm import line_dedup


def test_masked_lines(documents):
    lines = ["plain words here", " edge  gaps ", "a\tb\x0bc\x0cd\re", "x1 y 22 z3z end", "\t7\t", "", "   ", "caf\u00e9\u00a01 no\u2003gap 9", "a" * 300 + " 1"]
    want = [" ".join("<*>" if re.search("[0-9]", t) else t for t in re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
    df = documents([(1, "\n".join(lines)), (2, None)]).select("doc_id", line_dedup._masked(F.col("text")).alias("m"))
    assert {r["doc_id"]: r["m"] for r in df.collect()} == {1: want, 2: [""]}


def test_each_step_of_masking_is_computed_once(documents):
    plan = documents([(1, "a")]).select(line_dedup._masked(F.col("text")).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") == 2

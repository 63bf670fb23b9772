"""The coverage table names only queries that exist."""

import os
import re

import __spark_entry__ as entry_points


def test_named_queries_exist():
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "COVERAGE.md")
    with open(path) as f:
        rows = [line.split("|") for line in f if line.startswith("|") and not line.startswith(("| ID", "|---"))]
    named = {q for r in rows for q in re.findall(r"`([a-z0-9_]+)`", r[3])}
    known = set(entry_points.queries())
    assert {q for q in named if q not in known} <= {"tokens", "pred_score", "safe_names", "x_linked_denovo"}
    assert len(named & known) > 140

"""Queries over the given tables, one or more per operator, with SQL that gives the same rows."""

from __future__ import annotations

import importlib

MODULES = ["search", "family", "ingest", "cohorts", "storage", "alleles"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"workloads.{m}")


def all_queries() -> dict:
    from workloads.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    from workloads.registry import ORACLES

    _load()
    return dict(ORACLES)

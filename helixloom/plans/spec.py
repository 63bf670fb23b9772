"""A search as data: filters, attributes and options, run against either layout."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixloom.operators import predicates as P
from helixloom.operators import shaping as S
from helixloom.operators.reviews import exclude_rejected
from helixloom.sources.warehouse import Tables

# The filter kinds a spec may name.
FILTER_KINDS = [
    "filter_term", "filter_terms", "filter_range_gt", "filter_range_gte", "filter_range_lt", "filter_range_lte",
    "filter_exists", "must_not_exists", "must_wildcard", "nested_filter_term", "nested_filter_terms",
    "nested_filter_range_gte", "nested_filter_range_lte", "nested_filter_exists", "nested_must_wildcard",
]


@dataclass
class FieldFilter:
    """One used filter. ``value`` is a text (one value per line) or a list."""

    kind: str
    field: str
    value: Any
    path: str | None = None
    analyzer: str | None = None
    missing: str = "drop"


@dataclass
class Attribute:
    """One output column; ``label`` is its heading."""

    field: str
    path: str | None = None
    label: str | None = None


@dataclass
class QuerySpec:
    attributes: list[Attribute]
    filters: list[FieldFilter] = field(default_factory=list)
    exclude_rejected: bool = False
    limit: int | None = None
    mode: str | None = None
    kindred: int | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> QuerySpec:
        d = json.loads(text)
        d["attributes"] = [Attribute(**a) for a in d["attributes"]]
        d["filters"] = [FieldFilter(**f) for f in d["filters"]]
        return QuerySpec(**d)

    def used_filters(self) -> list[FieldFilter]:
        """A filter without input is not used."""
        return [f for f in self.filters if f.value not in (None, "", [])]

    def flat_attributes(self) -> list[str]:
        return [a.field for a in self.attributes if not a.path]

    def nested_attributes(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for a in self.attributes:
            if a.path:
                out.setdefault(a.path, []).append(a.field)
        return out


def _lines(value: Any) -> list:
    return [x.strip() for x in value.splitlines() if x.strip()] if isinstance(value, str) else list(value)


def _typed(kind: T.DataType, value: Any) -> Any:
    """Input text as a value of the column's type, so that the comparison stays on the column."""
    base = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if isinstance(base, T.IntegralType):
        return int(value)
    if isinstance(base, T.FractionalType):
        return float(value)
    if isinstance(base, T.BooleanType):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("true", "yes", "1")
    return value if isinstance(value, str) else str(value)


def _bound(kind: T.DataType, value: Any) -> Any:
    number = float(value.strip() if isinstance(value, str) else value)
    base = kind.elementType if isinstance(kind, T.ArrayType) else kind
    # A whole bound on a whole-number column stays whole: no cast of the column, so it is pushed down.
    return int(number) if isinstance(base, T.IntegralType) and number.is_integer() else number


_RANGES = {"gt": P.gt, "gte": P.gte, "lt": P.lt, "lte": P.lte}


def _range(c: Column, kind: T.DataType, op: str, value: Any, missing: str) -> Column:
    bound = _bound(kind, value)
    if isinstance(kind, T.ArrayType):
        test = F.exists(c, lambda x: _RANGES[op](x, bound))
        return test | c.isNull() if missing == "keep" else test
    return _RANGES[op](c, bound, missing)


def flat_predicate(f: FieldFilter, kind: T.DataType) -> Column:
    array, c = isinstance(kind, T.ArrayType), S.quoted(f.field)
    if f.kind == "filter_term":
        if f.analyzer:
            return P.all_of(*[P.text_term(c, v, f.analyzer) for v in _lines(f.value)])
        values = [f.value] if isinstance(f.value, str) else list(f.value)
        return P.term(c, [_typed(kind, v.strip() if isinstance(v, str) else v) for v in values], array)
    if f.kind == "filter_terms":
        if f.analyzer:
            return P.any_of(*[P.text_term(c, v, f.analyzer) for v in _lines(f.value)])
        return P.terms(c, [_typed(kind, v) for v in _lines(f.value)], array)
    if f.kind.startswith("filter_range_"):
        return _range(c, kind, f.kind.rsplit("_", 1)[1], f.value, f.missing)
    if f.kind == "filter_exists":
        return P.exists(c, f.value, array)
    if f.kind == "must_not_exists":
        return P.missing(c, array)
    if f.kind == "must_wildcard":
        return P.wildcard(c, f.value)
    raise ValueError(f"unknown filter kind {f.kind!r}")


def nested_predicate(f: FieldFilter, kind: T.DataType) -> P.Nested:
    array = isinstance(kind, T.ArrayType)
    if f.kind == "nested_filter_term":
        return P.nested_term(f.path, f.field, [v if f.analyzer else _typed(kind, v) for v in _lines(f.value)], array, f.analyzer)
    if f.kind == "nested_filter_terms":
        return P.nested_terms(f.path, f.field, [v if f.analyzer else _typed(kind, v) for v in _lines(f.value)], array, False, f.analyzer)
    if f.kind.startswith("nested_filter_range_"):
        op = f.kind.rsplit("_", 1)[1]
        return P.Nested(f.path, lambda get: _range(get(f.field), kind, op, f.value, f.missing))
    if f.kind == "nested_filter_exists":
        return P.nested_exists(f.path, f.field, f.value, array)
    if f.kind == "nested_must_wildcard":
        return P.nested_wildcard(f.path, f.field, f.value)
    raise ValueError(f"unknown filter kind {f.kind!r}")


def _mode_filters(spec: QuerySpec) -> list[P.Nested]:
    from helixloom.operators.inheritance import mode_predicates

    return mode_predicates(spec.mode) if spec.mode else []


def _mode_consequences(spec: QuerySpec, vep: bool) -> list[P.Nested]:
    """A condition on the document beside the user's own filters: it need not hold on the transcript those match."""
    from helixloom.operators.inheritance import mode_consequences

    return mode_consequences(spec.mode) if spec.mode and vep else []


def _finish(df: DataFrame, spec: QuerySpec, key: str, limit: int | None, order: Sequence[str] | None) -> DataFrame:
    """Attributes in the order asked for, key first; a limit takes the first rows of a total order."""
    shown = [a for a in spec.attributes if a.field != key]
    # Two attributes of one name are one column: the nested value, under the label of the last of them that has one.
    labels = {a.field: a.label for a in spec.attributes if a.label}
    out = df.select(key, *[S.quoted(c) for c in dict.fromkeys(a.field for a in shown)])
    if limit is not None:
        by = list(order or [key]) + [c for c in out.columns if c != key]
        sortable = [c for c in dict.fromkeys(by) if not isinstance(out.schema[c].dataType, T.MapType)]
        out = S.limit_rows(out, limit, sortable)
    return S.label_columns(out, labels)


def run_spec(tables: Tables, spec: QuerySpec, reviews: DataFrame | None = None, group: str | None = None,
             limit: int | str | None = "spec", order: Sequence[str] | None = None, dataset: str | None = None) -> DataFrame:
    """Run a search on the long layout.

    Flat filters and the filters of each path are plain conditions on their own table and reach
    its scan. Documents meet their matching elements through joins on the key; a path that is
    only filtered becomes a semi join. ``limit=None`` gives everything, as an export needs.
    """
    base, key = tables.base, tables.key
    used = spec.used_filters()
    flat = [flat_predicate(f, base.schema[f.field].dataType) for f in used if not f.path]
    nested = [nested_predicate(f, tables.paths[f.path].schema[f.field].dataType) for f in used if f.path]
    nested += _mode_filters(spec)
    rows = base.filter(P.all_of(*flat)) if flat else base
    if spec.exclude_rejected and reviews is not None:
        rows = exclude_rejected(rows, reviews, group, key, dataset)
    # Conditions on columns that say the same of a document and its elements are given to both scans.
    both = {c: [flat_predicate(f, base.schema[c].dataType) for f in used if not f.path and f.field == c] for c in tables.shared}

    def elements(path: str) -> tuple[DataFrame, list[str]]:
        table = tables.paths[path]
        held = [c for c in tables.shared if c in table.columns and c in base.columns]
        tests = [t for c in held for t in both[c]]
        return (table.filter(P.all_of(*tests)) if tests else table), [*held, key]

    for p, preds in P.by_path(_mode_consequences(spec, "CSQ_nested" in tables.paths)).items():
        table, on = elements(p)
        rows = rows.join(table.filter(P.row_condition(preds)).select(*on).distinct(), on, "left_semi")
    if spec.kindred is not None:
        rows = _kindred_long(rows, *elements("sample"), nested, spec.kindred)
    wanted = spec.nested_attributes()
    involved = {p: elements(p) for p in dict.fromkeys([*P.by_path(nested), *wanted])}
    keep = [c for c in dict.fromkeys([*tables.shared, *spec.flat_attributes()]) if c in base.columns]
    out = S.flatten_long(rows, key, involved, wanted, keep, nested, tables.unique)
    return _finish(out, spec, key, spec.limit if limit == "spec" else limit, order)


def _kindred_long(rows: DataFrame, samples: DataFrame, on: list[str], nested: Sequence[P.Nested], n: int) -> DataFrame:
    from helixloom.operators.inheritance import kindred

    grouped = P.by_path(nested).get("sample", [])
    matched = samples.filter(P.row_condition(grouped)) if grouped else samples
    shared = kindred(matched.select(*on, "Family_ID"), n, on[-1]).select(*on).distinct()
    return rows.join(shared, on, "left_semi")


def run_spec_nested(df: DataFrame, spec: QuerySpec, key: str = "variant_key", skip: Sequence[str] = (),
                    cap: int | None = None, reviews: DataFrame | None = None, group: str | None = None,
                    limit: int | str | None = "spec", order: Sequence[str] | None = None, dataset: str | None = None) -> DataFrame:
    """The same search on documents that hold their elements as arrays, for modest array sizes."""
    used = spec.used_filters()

    def member(path: str, f: str) -> T.DataType:
        return df.schema[path].dataType.elementType[f].dataType

    nested = [nested_predicate(f, member(f.path, f.field)) for f in used if f.path]
    nested += _mode_filters(spec)
    grouped = P.by_path(nested)
    tests = [flat_predicate(f, df.schema[f.field].dataType) for f in used if not f.path]
    tests += [P.same_element(ps) for ps in [*grouped.values(), *P.by_path(_mode_consequences(spec, "CSQ_nested" in df.columns)).values()]]
    rows = df.filter(P.all_of(*tests)) if tests else df
    if spec.exclude_rejected and reviews is not None:
        rows = exclude_rejected(rows, reviews, group, key, dataset)
    if spec.kindred is not None:
        families = F.array_distinct(F.transform(
            F.filter("sample", P.element_condition(grouped["sample"])) if "sample" in grouped else F.col("sample"),
            lambda e: e["Family_ID"]))
        rows = rows.filter(F.size(F.array_compact(families)) > spec.kindred)
    wanted = spec.nested_attributes()
    for p, fields in wanted.items():
        rows = S.matching_elements(rows, p, grouped.get(p, []), list(dict.fromkeys(fields)), cap if p in grouped else None)
    out = S.flatten(rows, key, list(wanted), spec.flat_attributes(), skip)
    return _finish(out, spec, key, spec.limit if limit == "spec" else limit, order)


def search_mode(tables: Tables, mode: str, spec: QuerySpec, **options: Any) -> DataFrame:
    """A search among samples tagged with an inheritance mode; the tag and the spec's own sample
    filters must hold on the same genotype."""
    return run_spec(tables, QuerySpec(spec.attributes, spec.filters, spec.exclude_rejected, spec.limit, mode, spec.kindred), **options)

"""Filters on flat columns and on nested elements.

A nested filter is written once against a field accessor. It can then be asked of an array
element (array layout) or of a row (long layout, one row per element), with the same meaning:
all filters on one path must hold on the same element.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.functions.scalars import column


def _values(v: Any) -> list:
    return list(v) if isinstance(v, (list, tuple, set)) else [v]


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# --- flat --------------------------------------------------------------------------------

def term(c: Column | str, v: Any, array: bool = False) -> Column:
    """Equals. A list of values must all hold, which only an array column can satisfy."""
    c = column(c)
    return reduce(and_, [F.array_contains(c, x) if array else c == F.lit(x) for x in _values(v)])


def terms(c: Column | str, vs: Iterable, array: bool = False) -> Column:
    """Any of the values. Long uploaded lists are a join: see ``shaping.terms_file``."""
    c, vs = column(c), _values(vs)
    return F.arrays_overlap(c, F.array(*[F.lit(x) for x in vs])) if array else c.isin(vs)


def not_terms(c: Column | str, vs: Iterable, array: bool = False) -> Column:
    """None of the values; a missing field passes."""
    return ~_true(terms(c, vs, array))


def _compared(test: Column, c: Column, missing: str) -> Column:
    if missing not in ("drop", "keep"):
        raise ValueError("missing must be 'drop' or 'keep'")
    return test | c.isNull() if missing == "keep" else test


def gt(c: Column | str, v: Any, missing: str = "drop") -> Column:
    return _compared(column(c) > F.lit(v), column(c), missing)


def gte(c: Column | str, v: Any, missing: str = "drop") -> Column:
    return _compared(column(c) >= F.lit(v), column(c), missing)


def lt(c: Column | str, v: Any, missing: str = "drop") -> Column:
    """Below. ``missing='keep'`` also keeps variants without a value (rare-variant filters)."""
    return _compared(column(c) < F.lit(v), column(c), missing)


def lte(c: Column | str, v: Any, missing: str = "drop") -> Column:
    return _compared(column(c) <= F.lit(v), column(c), missing)


def missing(c: Column | str, array: bool = False) -> Column:
    c = column(c)
    return c.isNull() | (F.size(c) == 0) if array else c.isNull()


def exists(c: Column | str, choice: str = "only", array: bool = False) -> Column:
    """``only`` keeps rows that have the field, any other choice those that lack it."""
    absent = missing(c, array)
    return ~absent if choice == "only" else absent


def wildcard(c: Column | str, glob: str) -> Column:
    """``*`` is any run, ``?`` one character. LIKE, so that a prefix reaches the scan."""
    pattern = re.sub(r"([\\%_])", r"\\\1", glob).replace("*", "%").replace("?", "_")
    return column(c).like(pattern)


def outside(c: Column | str, low: Any, high: Any) -> Column:
    """Not inside the open interval; both bounds and missing values pass."""
    c = column(c)
    return ~_true((c > F.lit(low)) & (c < F.lit(high)))


def text_term(c: Column | str, v: str, analyzer: str = "simple") -> Column:
    """A whole word of an analysed text: a lower-cased run of letters, or as written between blanks.

    One regular expression search; no list of all the text's words is built. A value that could
    never be one word matches nothing.
    """
    c, word = column(c), v if analyzer == "whitespace" else v.lower()
    if not word or (any(x.isspace() for x in word) if analyzer == "whitespace" else not word.isalpha()):
        return c.isNotNull() & F.lit(False)
    if analyzer == "whitespace":
        return c.rlike(rf"(^|\s)\Q{word}\E(\s|$)")
    return F.lower(c).rlike(rf"(^|[^\p{{L}}]){word}([^\p{{L}}]|$)")


def any_of(*preds: Column) -> Column:
    return reduce(or_, preds)


def all_of(*preds: Column) -> Column:
    """All of them; without any filter every row passes."""
    return reduce(and_, preds) if preds else F.lit(True)


# --- nested ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Nested:
    """A condition on one element of ``path``."""

    path: str
    test: Callable[[Callable[[str], Column]], Column]

    def on_element(self, element: Column) -> Column:
        return self.test(lambda f: element[f])

    def on_row(self) -> Column:
        return self.test(lambda f: F.col(f"`{f}`"))


def nested_term(path: str, f: str, vs: Any, array: bool = False, analyzer: str | None = None) -> Nested:
    """Every value on the same element."""
    if analyzer:
        return Nested(path, lambda get: all_of(*[text_term(get(f), v, analyzer) for v in _values(vs)]))
    return Nested(path, lambda get: term(get(f), vs, array))


def nested_terms(path: str, f: str, vs: Iterable, array: bool = False, split_ws: bool = False,
                 analyzer: str | None = None) -> Nested:
    """Any value. ``split_ws`` also cuts each value at blanks, for pasted id lists."""
    vs = [w for v in _values(vs) for w in (str(v).split() if split_ws else [v])]
    if analyzer:
        return Nested(path, lambda get: any_of(*[text_term(get(f), v, analyzer) for v in vs]))
    return Nested(path, lambda get: terms(get(f), vs, array))


def nested_gte(path: str, f: str, v: Any) -> Nested:
    return Nested(path, lambda get: gte(get(f), v))


def nested_lte(path: str, f: str, v: Any) -> Nested:
    return Nested(path, lambda get: lte(get(f), v))


def nested_exists(path: str, f: str, choice: str = "only", array: bool = False) -> Nested:
    """An element that has the field (or, for ``excluded``, an element that lacks it)."""
    return Nested(path, lambda get: exists(get(f), choice, array))


def nested_wildcard(path: str, f: str, glob: str) -> Nested:
    return Nested(path, lambda get: wildcard(get(f), glob))


def by_path(preds: Iterable[Nested]) -> dict[str, list[Nested]]:
    grouped: dict[str, list[Nested]] = {}
    for p in preds:
        grouped.setdefault(p.path, []).append(p)
    return grouped


def element_condition(preds: Sequence[Nested]) -> Callable[[Column], Column]:
    """One lambda for all conditions on a path; missing counts as not met."""
    return lambda element: _true(all_of(*[p.on_element(element) for p in preds]))


def row_condition(preds: Sequence[Nested]) -> Column:
    return all_of(*[p.on_row() for p in preds])


def same_element(preds: Sequence[Nested]) -> Column:
    """Array layout: some element meets every condition. Always true or false, never NULL."""
    path, = by_path(preds)
    return _true(F.exists(F.col(path), element_condition(preds)))


def with_element(df: DataFrame, rows: DataFrame, key: str | list[str], preds: Sequence[Nested]) -> DataFrame:
    """Long layout: rows of ``df`` that own an element meeting every condition.

    The conditions are ordinary filters on the element table, so they reach its scan; only keys
    of matching elements travel, made distinct before the shuffle.
    """
    keys = [key] if isinstance(key, str) else key
    return df.join(rows.filter(row_condition(preds)).select(*keys).distinct(), keys, "left_semi")

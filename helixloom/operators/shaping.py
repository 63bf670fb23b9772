"""Projection, matching elements, flattening, limits, labels and text rendering."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixloom.functions.scalars import safe_name
from helixloom.operators.predicates import Nested, by_path, element_condition, row_condition


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def select_attributes(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Flat fields and ``path.field`` members in the order asked for.

    Members of one path come back as one array of trimmed elements at the place of its first.
    """
    members: dict[str, list[str]] = {}
    for a in attrs:
        if a not in df.columns and "." in a:
            path, field = a.split(".", 1)
            members.setdefault(path, []).append(field)
    out, done = [], set()
    for a in attrs:
        if a in df.columns:
            out.append(quoted(a))
            continue
        path = a.split(".", 1)[0]
        if path not in done:
            done.add(path)
            out.append(trim_elements(quoted(path), members[path]).alias(path))
    return df.select(*out)


def trim_elements(array: Column, fields: Sequence[str]) -> Column:
    return F.transform(array, lambda e: F.struct(*[e[f].alias(f) for f in fields]))


def matching_elements(df: DataFrame, path: str, preds: Sequence[Nested], fields: Sequence[str],
                      cap: int | None = None) -> DataFrame:
    """Replace ``path`` by the elements that met its filters, or by all if it has none.

    ``cap`` limits the elements per document; the search service it mirrors used 100.
    """
    array = quoted(path)
    if preds:
        array = F.filter(array, element_condition(preds))
    array = trim_elements(array, fields)
    if cap is not None:
        array = F.slice(array, 1, cap)
    return df.withColumns({path: array})


def _element_fields(df: DataFrame, path: str) -> list[str]:
    kind = df.schema[path].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)):
        raise TypeError(f"{path} is not an array of structs")
    return kind.elementType.fieldNames()


def flatten(df: DataFrame, key: str | Sequence[str], paths: Sequence[str], keep: Sequence[str] = (),
            skip: Sequence[str] = ()) -> DataFrame:
    """One row per combination of elements of all paths, for documents held as arrays.

    ``keep`` are flat fields, ``skip`` are array fields carried along as they are. A later path
    wins over an earlier one with the same field, and any path over a flat field. If a present
    array is empty the whole product is empty, and the document comes back once without elements;
    an absent (NULL) array takes no part. Rows of one document are made distinct.
    """
    keys = [key] if isinstance(key, str) else list(key)
    fields = {p: _element_fields(df, p) for p in paths}
    flat = [c for c in keep if c not in keys]
    carried = [c for c in skip if c not in flat and c not in keys]
    some_empty = F.lit(False)
    for p in paths:
        some_empty = some_empty | F.coalesce(F.size(quoted(p)) == 0, F.lit(False))
    out = df.select(*keys, *[quoted(c) for c in flat + carried],
                    *[F.when(~some_empty, quoted(p)).alias(p) for p in paths])
    for p in paths:
        rest = [quoted(c) for c in out.columns if c != p]
        out = out.select(*rest, F.explode_outer(p).alias(p))
    sources = _sources(flat + carried, {p: (fields[p], lambda f, p=p: quoted(p)[f]) for p in paths})
    return out.select(*keys, *[_first_value(c).alias(f) for f, c in sources.items()]).dropDuplicates()


def _sources(flat: Sequence[str], paths: Mapping[str, tuple]) -> dict[str, list[Column]]:
    """Output field -> the columns that may hold it, strongest first: later paths, then flat."""
    out: dict[str, list[Column]] = {f: [quoted(f)] for f in flat}
    for members, get in paths.values():
        for f in members:
            out[f] = [get(f), *out.get(f, [])]
    return out


def _first_value(candidates: Sequence[Column]) -> Column:
    return candidates[0] if len(candidates) == 1 else F.coalesce(*candidates)


def flatten_long(base: DataFrame, key: str | Sequence[str], elements: Mapping[str, DataFrame | tuple[DataFrame, Sequence[str]]],
                 fields: Mapping[str, Sequence[str]], keep: Sequence[str] = (),
                 preds: Iterable[Nested] = (), unique: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The same rows from long tables, one row per element, without building any array.

    Each element table is filtered, cut to the wanted fields and made distinct on its own; that
    spreads one huge document over many tasks and merges its copies before they travel. The
    joins on the key then produce distinct rows by construction, so no wide row is ever
    de-duplicated, and adaptive execution may still split a hot key. A path with filters must
    have a match, a path without keeps documents that have no element there. An element table may
    come with the columns it is joined on, which then have to be in ``keep`` or the key; further
    columns beside the key (chromosome, position) let stored tables prune each other.
    """
    keys = [key] if isinstance(key, str) else list(key)
    grouped = by_path(preds)
    flat = [c for c in keep if c not in keys]
    out = base.select(*keys, *[quoted(c) for c in flat])
    shown = {}
    for i, (p, given) in enumerate(elements.items()):
        rows, on = (given[0], list(given[1])) if isinstance(given, tuple) else (given, keys)
        kept = rows.filter(row_condition(grouped[p])) if p in grouped else rows
        members = list(fields.get(p, ()))
        if members:
            names = {f: f"_{i}_{f}" for f in members}
            side = kept.select(*on, *[quoted(f).alias(n) for f, n in names.items()])
            identity = (unique or {}).get(p)
            if not identity or not set(identity) <= set(members):
                side = side.distinct()
            out = out.join(side, on, "inner" if p in grouped else "left")
            shown[p] = (members, lambda f, names=names: quoted(names[f]))
        elif p in grouped:
            out = out.join(kept.select(*on).distinct(), on, "left_semi")
    sources = _sources(flat, shown)
    result = out.select(*keys, *[_first_value(c).alias(f) for f, c in sources.items()])
    # Only where two sources share a field name can two combinations look the same.
    return result.dropDuplicates() if any(len(c) > 1 for c in sources.values()) else result


def limit_rows(df: DataFrame, n: int | None = None, order: Sequence[Column | str] = ()) -> DataFrame:
    """The first ``n`` rows of a stated order; ``None`` gives all rows, unsorted."""
    return df if n is None else df.orderBy(*order).limit(n)


def label_columns(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    return df.select(*[quoted(c).alias(labels.get(c, c)) for c in df.columns])


def stringify(df: DataFrame, missing: str = "None") -> DataFrame:
    """All columns as text for export; arrays and structs as JSON."""
    def text(field: T.StructField) -> Column:
        c = quoted(field.name)
        nested = isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType))
        return F.coalesce(F.to_json(c) if nested else c.cast("string"), F.lit(missing)).alias(field.name)

    return df.select(*[text(f) for f in df.schema.fields])


def _has_value(field: T.StructField) -> Column:
    c = quoted(field.name)
    if isinstance(field.dataType, T.ArrayType):
        return c.isNotNull() & (F.size(c) > 0)
    if isinstance(field.dataType, T.StringType):
        return c.isNotNull() & (c != "")
    if isinstance(field.dataType, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(field.dataType, T.NumericType):
        return c.isNotNull() & (c != 0)
    return c.isNotNull()


def nonempty_groups(df: DataFrame, groups: Mapping[str, Sequence[str]], out: str = "panels") -> DataFrame:
    """Per row, the names of the field groups in which any field has a value."""
    names = []
    for name, members in groups.items():
        test = F.lit(False)
        for m in members:
            if m in df.columns:
                test = test | _has_value(df.schema[m])
        names.append(F.when(test, F.lit(name)))
    return df.withColumns({out: F.array_compact(F.array(*names))})


def terms_file(df: DataFrame, c: str, ids: DataFrame, id_column: str = "value", key: str | None = None) -> DataFrame:
    """Rows whose field is in an uploaded list of any length: a semi join, not a literal list.

    Spark broadcasts the list only when its own size estimate allows it. For an array field give
    the row ``key``: its values are exploded, so that the join stays an equality join.
    """
    wanted = ids.select(F.col(id_column).alias("_wanted")).distinct()
    if key is None:
        return df.join(wanted, quoted(c) == F.col("_wanted"), "left_semi")
    hits = df.select(key, F.explode(quoted(c)).alias("_wanted")).join(wanted, "_wanted", "left_semi")
    return df.join(hits.select(key).distinct(), key, "left_semi")


# Width of the position bins in which intervals and variants meet.
INTERVAL_BIN = 1_000_000


def outside_intervals(df: DataFrame, intervals: DataFrame, chrom: str = "CHROM", pos: str = "POS",
                      width: int = INTERVAL_BIN) -> DataFrame:
    """Rows not inside any open interval (chrom, start, end); bounds stay, as do missing positions.

    Intervals are written once per bin they touch, so the range test becomes an equality join on
    (chromosome, bin) that can be shuffled and split like any other. A few fixed intervals are
    better given as a condition: see ``predicates.outside``.
    """
    binned = intervals.select(
        F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"),
        F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("_b"))
    inside = ((quoted(chrom) == F.col("_c")) & (F.floor(quoted(pos) / width) == F.col("_b"))
              & (quoted(pos) > F.col("_s")) & (quoted(pos) < F.col("_e")))
    return df.join(binned, inside, "left_anti")


def safe_names(df: DataFrame) -> DataFrame:
    """Columns without dots in their names."""
    return df.toDF(*[safe_name(c) for c in df.columns])

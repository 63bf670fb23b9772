"""Quality classifier by co-training.

Two views of a document are learned apart: its text (hashed byte trigrams, and how much they repeat) and its metadata (language,
source, length and layout). Both start from the labelled rows. In each round both views judge every unlabelled document, and a
view's most confident guesses (a share of all documents that grows by `SHARE` a round, in the proportions of the classes)
become labels for the other one in its next fit; each round guesses anew. Held-out labelled rows calibrate each view (a logistic
curve of its log-odds) and weigh the two together; every document is scored.

A fit takes a bounded sample of labelled rows: at most `labelled` labelled ones, and at most `pool` of those that the other view
has labelled, the smallest by a hash of doc_id. What counts as confident is decided over all unlabelled documents, and scoring
reads all rows and whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixloom.llm.common import fit_logistic, lean, packed, released, stored, texts, unpacked

LABELLED = 3_000
POOL = 3_000
ROUNDS = 3
# Share of the unlabelled documents that a round adds to the confident ones, and the log-odds (p = 0.95) they need in any case.
SHARE = 0.1
SURE = float(np.log(0.95 / 0.05))
GRAMS = 2_048
NAMES = 32
PIECE = 1 << 20


def text_view(text: bytes) -> np.ndarray:
    """Square roots of trigram shares in `GRAMS` buckets, then concentration of trigrams and share of distinct words."""
    counts = np.zeros(GRAMS, np.int64)
    for at in range(0, max(1, len(text) - 2), PIECE):
        b = np.frombuffer(text, np.uint8, min(len(text) - at, PIECE + 2), at).astype(np.uint32)
        if len(b) > 2:
            h = (((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(21)
            counts += np.bincount(h, minlength=GRAMS)
    words = text.split()
    shares = counts / max(1, counts.sum())
    return np.concatenate([np.sqrt(shares), [np.sqrt((shares ** 2).sum()), len(set(words)) / max(1, len(words)) ** 0.9]]).astype(np.float32)


def meta_view(text: bytes, lang: str | None, source: str | None) -> np.ndarray:
    """Hashed language and source, size, and shares of kinds of characters and lines."""
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(1, len(text))
    upper, lower, digits = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum()
    marks = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()
    stops = seen[[33, 44, 46, 63]].sum()
    lines, spaces = seen[10] + 1, seen[32]
    names = np.zeros(NAMES, np.float32)
    for kind, name in (("lang", lang), ("source", source)):
        if name is not None:
            names[zlib.crc32(f"{kind}={name}".encode()) % NAMES] += 0.3
    return np.concatenate([names, [
        np.log1p(len(text)) / 10, np.log1p(lines) / 5, np.log1p(n / lines) / 5, upper / (upper + lower + 1), 5 * digits / n,
        5 * (marks - stops) / n, 5 * stops / n, 3 * spaces / n, (seen[128:].sum()) / n]]).astype(np.float32)


def _score(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


# Rows and labels for the fit of the text view and for that of the metadata view.
Guesses = list[tuple[np.ndarray, np.ndarray]]


def _local_guesses(views: list[np.ndarray]) -> Callable[[list[np.ndarray], float, int], Guesses]:
    """Guesses over unlabelled rows at hand."""
    def guesses(w: list[np.ndarray], good_share: float, turn: int) -> Guesses:
        out = []
        for v in (1, 0):
            odds, share = _score(views[v], w[v]), SHARE * (turn + 1)
            if not len(odds):
                return []
            low, high = np.quantile(odds, [share * (1 - good_share), 1 - share * good_share])
            bad, good = np.flatnonzero(odds <= min(low, -SURE)), np.flatnonzero(odds >= max(high, SURE))
            out.append((views[1 - v][np.append(bad, good)], np.append(np.zeros(len(bad)), np.ones(len(good)))))
        return out

    return guesses


def cotrain(views: list[np.ndarray], y: np.ndarray, rounds: int = ROUNDS, guesses: Callable[[list[np.ndarray], float, int], Guesses] | None = None) -> dict:
    """Weights of both views, of their calibration and of their combination.

    Rows are in a random but fixed order; y is NaN for unlabelled ones. Every fourth labelled row is held out. `guesses` gives what the views,
    by their weights, teach each other; by default the unlabelled rows of `views` are guessed.
    """
    known = np.flatnonzero(~np.isnan(y))
    guesses = guesses or _local_guesses([v[np.isnan(y)] for v in views])
    good_share = float(y[known].mean())
    test = known[::4]
    train = np.setdiff1d(known, test)
    if len(np.unique(y[test])) < 2 or len(np.unique(y[train])) < 2:
        train = test = known
    more: Guesses = []
    for turn in range(rounds + 1):
        w = []
        for v in (0, 1):
            x, label = [views[v][train]], [y[train]]
            if more:
                x, label = [*x, more[v][0]], [*label, more[v][1]]
            w.append(fit_logistic(np.concatenate(x), np.concatenate(label)))
        if turn < rounds:
            more = guesses(w, good_share, turn)
            if not more:
                break
    odds = np.stack([_score(views[v][test], w[v]) for v in (0, 1)], axis=1)
    scale = [fit_logistic(odds[:, [v]], y[test], 1e-3) for v in (0, 1)]
    calibrated = np.stack([odds[:, v] * scale[v][0] + scale[v][1] for v in (0, 1)], axis=1)
    return {"text": w[0], "meta": w[1], "scale": scale, "both": fit_logistic(calibrated, y[test], 1e-3)}


def judge(model: dict, x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probabilities of good quality: by text, by metadata, by both."""
    odds = [_score(v, model[k]) * s[0] + s[1] for v, k, s in ((x, "text", model["scale"][0]), (m, "meta", model["scale"][1]))]
    both = odds[0] * model["both"][0] + odds[1] * model["both"][1] + model["both"][2]
    return 1 / (1 + np.exp(-np.clip(np.stack([*odds, both], axis=1), -30, 30)))


def _rows(columns: tuple[pa.Array, pa.Array, pa.Array]) -> Iterator[tuple[bytes, str | None, str | None]]:
    """Text, lang and source, a few texts at a time."""
    text, lang, source = columns
    return zip(texts(text), lang.to_pylist(), source.to_pylist())


@F.arrow_udf(T.StructType().add("x", T.BinaryType()).add("m", T.BinaryType()))
def _features(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Both views as half-precision numbers, to keep the sample small."""
    for columns in lean(batches):
        x, m = [], []
        for t, a, b in _rows(columns):
            x.append(text_view(t).astype(np.float16).tobytes())
            m.append(meta_view(t, a, b).astype(np.float16).tobytes())
        yield pa.StructArray.from_arrays([pa.array(x, pa.binary()), pa.array(m, pa.binary())], ["x", "m"])
        columns = x = m = None


def _sampled(docs: DataFrame, wanted: DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Both views, labels y and kinds v of the bounded table wanted (doc_id, y, v), in the order of a hash of doc_id.

    Of rows that share a doc_id the one whose text has the smallest hash counts.
    """
    named = docs.select("doc_id", F.struct("text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")).alias("r"))
    # The ids are bounded and broadcast; the documents stay where they are, and rows of one id merge before they travel.
    rows = named.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "y", "v").agg(
        F.min_by("r", F.struct(F.xxhash64("r.text"), "r.lang", "r.source")).alias("r"))
    rows = rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", "y", "v", _features("r.text", "r.lang", "r.source").alias("f")).toArrow()
    order = pc.sort_indices(rows, [(k, "ascending") for k in ("h", "doc_id", "y", "v")])
    rows = rows.take(order)
    flat = [f for chunk in rows["f"].chunks for f in zip(chunk.field("x").to_pylist(), chunk.field("m").to_pylist())]
    views = [np.array([np.frombuffer(f[k], np.float16) for f in flat], np.float32).reshape(len(flat), n) for k, n in ((0, GRAMS + 2), (1, NAMES + 9))]
    return views, rows["y"].to_numpy(), rows["v"].to_numpy()


def _log_odds(docs: DataFrame, w: list[np.ndarray]) -> DataFrame:
    """doc_id and the log-odds by text (t) and by metadata (m) of every row with an id."""
    sent = docs.sparkSession.sparkContext.broadcast(w)

    @F.arrow_udf("struct<t: double, m: double>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in lean(batches):
            t, m = np.zeros(len(columns[0])), np.zeros(len(columns[0]))
            for i, (b, k, s) in enumerate(_rows(columns)):
                t[i], m[i] = _score(text_view(b), sent.value[0]), _score(meta_view(b, k, s), sent.value[1])
            yield pa.StructArray.from_arrays([pa.array(t), pa.array(m)], ["t", "m"])
            columns = None

    odds = of.asNondeterministic()(F.col("text"), F.col("lang").cast("string"), F.col("source").cast("string"))
    return docs.filter("doc_id is not null").select("doc_id", odds.alias("o")).select("doc_id", "o.t", "o.m")


def _spark_guesses(docs: DataFrame, good: DataFrame, pool: int) -> Callable[[list[np.ndarray], float, int], Guesses]:
    """Guesses over all documents that are not in `good`: thresholds over all of them, then a sample of at most `pool` per view."""
    def guesses(w: list[np.ndarray], good_share: float, turn: int) -> Guesses:
        # Only ids and two numbers meet the labels, never texts.
        odds = stored(_log_odds(docs, w).join(good.select("doc_id"), "doc_id", "left_anti"), "odds")
        share, bads = SHARE * (turn + 1), max(1, round(pool * (1 - good_share)))
        cuts = odds.agg(*[F.percentile_approx(c, [share * (1 - good_share), 1 - share * good_share], 10_000).alias(c) for c in ("t", "m")]).first()
        wanted = None
        for teacher, pupil in (("t", 1), ("m", 0)):
            low, high = cuts[teacher]
            for sure, label, most in ((F.col(teacher) <= min(low, -SURE), 0.0, bads), (F.col(teacher) >= max(high, SURE), 1.0, max(1, pool - bads))):
                picked = odds.filter(sure).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
                picked = picked.select("doc_id", F.lit(label).alias("y"), F.lit(pupil).alias("v"))
                wanted = picked if wanted is None else wanted.unionByName(picked)
        views, y, v = _sampled(docs, wanted)
        del picked, wanted
        released(odds)
        return [(views[k][v == k], y[v == k]) for k in (0, 1)]

    return guesses


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS) -> dict | None:
    """The co-trained model, or None where the labels lack one of the classes. Rows of `labels` without quality are unlabelled."""
    good = labels.filter("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("double").alias("y"))
    chosen = good.join(docs.select("doc_id"), "doc_id", "left_semi").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(labelled)
    views, y, _ = _sampled(docs, chosen.withColumn("v", F.lit(-1)))
    if len(np.unique(y)) < 2:
        return None
    unknown = docs.filter("doc_id is not null").select("doc_id").join(good.select("doc_id"), "doc_id", "left_anti")
    return cotrain(views, y, rounds if pool > 0 and not unknown.isEmpty() else 0, _spark_guesses(docs, good, pool))


def scores(docs: DataFrame, model: dict | None):
    """A column of struct p_text, p_meta, score for text, lang and source; without a model everything scores 1."""
    if model is None:
        return F.struct(F.lit(1.0).alias("p_text"), F.lit(1.0).alias("p_meta"), F.lit(1.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<p_text: double, p_meta: double, score: double>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in lean(batches):
            out = np.zeros((len(columns[0]), 3))
            for i, (t, a, b) in enumerate(_rows(columns)):
                out[i] = judge(sent.value, text_view(t)[None], meta_view(t, a, b)[None])[0]
            yield pa.StructArray.from_arrays([pa.array(out[:, k]) for k in range(3)], ["p_text", "p_meta", "score"])
            columns = None

    return of.asNondeterministic()(F.col("text"), F.col("lang").cast("string"), F.col("source").cast("string"))


def annotate(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, p_text, p_meta, score, keep; one row per input row.

    A null or empty text, language or source is a case of its own and is scored like any other. Without labels of both
    classes nothing is rejected. Different labels of one document all count, repeated ones once. Rows without doc_id are scored but
    teach nothing; of rows that share a doc_id one does. Other columns are not read.
    """
    model = fit(docs, labels, labelled, pool, rounds)
    return docs.select("doc_id", scores(docs, model).alias("s")).select("doc_id", "s.*", (F.col("s.score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS) -> DataFrame:
    """The rows whose score reaches the threshold, with all columns of the input."""
    model = fit(docs, labels, labelled, pool, rounds)
    rows = packed(docs, *[(c, F.col(c)) for c in ("text", "lang", "source")])
    return unpacked(rows.withColumn("s", scores(docs, model)).filter(F.col("s.score") >= threshold))

"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

Source shares of tokens are raised to an exponent t and normalised: t = 1 keeps the shares, t = 0 makes sources equal. The
exponent is found by bisection so that the weights reach a target entropy (a share of the logarithm of the number of
sources), or so that no source is repeated more often than `max_repeats` times as much as the least repeated one.

A weight times the token budget is a source's quota: some whole passes (epochs) over its documents and a part of one
more. A source of n documents is dealt by hash into about sqrt(n) blocks. In each epoch a source's blocks come in an order
of their own (a hash of seed, source, epoch and block), and inside a block its documents do; the part epoch takes
documents in that order while they end inside the quota. Block totals say which blocks fit whole; a running sum over
documents is needed in one block of a source only. No task orders more than about sqrt(n) rows of a source of n.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixloom.llm.common import packed, stored

# More sources than this are refused: their weights pass through the driver.
MAX_SOURCES = 1_000_000


def token_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    return words.cast("long")


def weights_at(shares: dict, t: float) -> dict:
    raised = {s: p ** t for s, p in shares.items()}
    total = sum(raised.values())
    return {s: v / total for s, v in raised.items()}


def entropy(weights: dict) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def exponent(shares: dict, target_entropy: float | None = None, max_repeats: float | None = None, steps: int = 60) -> float:
    """The largest exponent in [0, 1] whose entropy reaches the target share, or the smallest that keeps the repeats."""
    if len(shares) < 2:
        return 1.0

    def flat_enough(t: float) -> bool:
        w = weights_at(shares, t)
        if target_entropy is not None:
            return entropy(w) >= target_entropy * math.log(len(shares))
        rates = [w[s] / p for s, p in shares.items()]
        return max(rates) > max_repeats * min(rates)

    low, high = 0.0, 1.0
    if flat_enough(high) or not flat_enough(low):
        # Either the shares themselves will do, or even equal weights do not break the limit.
        return 1.0 if flat_enough(high) else 0.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if flat_enough(mid) else (low, mid)
    return low if target_entropy is not None else high


def plan(tokens: dict, budget: int | None = None, target_entropy: float | None = None, max_repeats: float | None = None) -> list[tuple]:
    """(source, tokens, weight, quota, epochs, rest) per source with tokens.

    Without a budget it is the least that passes over every source at least once.
    """
    total = sum(tokens.values())
    shares = {s: n / total for s, n in tokens.items() if n > 0} if total else {}
    w = weights_at(shares, exponent(shares, target_entropy, max_repeats))
    if budget is None:
        # The source used most sparingly gets exactly one pass.
        per_token = max((tokens[s] / v for s, v in w.items()), default=0)
        quotas = {s: max(tokens[s], math.floor(round(v * per_token, 3))) for s, v in w.items()}
    else:
        quotas = {s: math.floor(round(v * budget, 3)) for s, v in w.items()}
    return [(s, tokens[s], w[s], q, q // tokens[s], q % tokens[s]) for s, q in sorted(quotas.items(), key=lambda x: str(x[0]))]


def _dice(*parts) -> Column:
    """A number below 2^32 from a text of parts; any engine with MD5 gives the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, budget: int | None = None, target_entropy: float | None = None, max_repeats: float | None = None,
        seed: int = 7) -> DataFrame:
    """All columns of the input, a row per use of a document, with `mix`: struct of epoch, block, place, tokens, weight.

    `epoch` counts passes, `block` and `place` order the rows of a source inside one (place restarts in each block). A
    column of the input that is called mix is replaced. A null source is a source of its own. Documents without words
    have no tokens and come with every whole epoch of their source; sources without any token are used once. Repeated
    rows are separate documents.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("name either target_entropy or max_repeats")
    spark = docs.sparkSession
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    rows = packed(docs.drop("mix"), ("source", source), ("text", F.col("text")), ("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    totals = rows.groupBy("source").agg(F.sum(token_count(F.col("text"))).alias("n"), F.count(F.lit(1)).alias("docs"))
    found = totals.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    blocks = {r.source: math.isqrt(r.docs - 1) + 1 for r in found}
    planned = [(s, w, e, rest, blocks[s]) for s, _, w, _, e, rest in plan({r.source: r.n for r in found if r.n}, budget, target_entropy, max_repeats)]
    planned += [(r.source, 0.0, 1, 0, blocks[r.source]) for r in found if not r.n]
    quotas = spark.createDataFrame(planned, "source string, weight double, epochs long, rest long, blocks long")
    dealt = rows.join(F.broadcast(quotas) if len(planned) <= 10_000 else quotas, "source").withColumn("block", F.pmod(_dice(F.lit(seed), "id"), F.col("blocks")))
    per_block = dealt.filter("rest > 0").groupBy("source", "epochs", "rest", "block").agg(F.sum(token_count(F.col("text"))).alias("held"))
    ahead = Window.partitionBy("source").orderBy(_dice(F.lit(seed), "source", "epochs", "block"), "block").rowsBetween(Window.unboundedPreceding, 0)
    starts = stored(per_block.withColumn("from", F.sum("held").over(ahead) - F.col("held")).filter("from < rest"), "blocks")
    fits = starts.filter("from + held <= rest").select("source", "block", F.lit(1).cast("long").alias("more"))
    cut = starts.filter("from + held > rest").select("source", "block", "from")
    place = _dice(F.lit(seed), "epoch", "id")
    # Whole epochs, and one more for the blocks that fit into the part epoch.
    uses = F.col("epochs") + F.coalesce("more", F.lit(0))
    whole = (dealt.join(fits, ["source", "block"], "left").filter(uses > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), uses - 1)))
             .withColumn("tokens", token_count(F.col("text"))))
    order = Window.partitionBy("source", "block").orderBy(place, "id", F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, 0)
    edge = (dealt.join(cut, ["source", "block"]).withColumn("epoch", F.col("epochs")).withColumn("tokens", token_count(F.col("text")))
            .withColumn("ends", F.sum("tokens").over(order) + F.col("from")).filter("ends <= rest"))
    out = ["row", F.struct("epoch", "block", place.alias("place"), "tokens", "weight").alias("mix")]
    return whole.select(*out).unionByName(edge.select(*out)).select("row.*", "mix")

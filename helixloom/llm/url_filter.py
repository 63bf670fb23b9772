"""URL filter: rules for hosts and paths, and a logistic regression on hashed character n-grams for the rest.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end. A null
url or one without `://` has neither. A rule (host, path, verdict) fits its host and all subdomains where the url's path starts
with the rule's; the longest rule wins, at equal length the one with the longer host.

The classifier is trained from a small labelled table of urls (at most `MAX_LABELLED` rows, the smallest by a hash of the
url). Each url is judged alone; only the url column is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm.common import fit_logistic

MAX_LABELLED = 20_000
MAX_RULES = 1_000_000
BUCKETS = 4_096
SIZES = (3, 4, 5)

# Names of hosts and paths for the labelled table.
BAD_NAMES = ("ad-clicks ad-server adtracker adult-chat adult-dating adultvideo adults-only banner-ads best-casino bet-live betting-tips big-bets bonus-casino buy-pills "
             "casino-bonus casino-online cheap-meds click-track clickbait diet-pills escort-girls fast-money free-casino free-gifts free-porn free-spins "
             "girls-live hot-girls hotsex jackpot-slots keygen-crack link-farm live-bets live-cams live-sex loans-fast lottery-winner lucky-slots mega-jackpot "
             "miracle-diet money-fast online-casino online-pills online-poker online-slots payday-loans pills-shop poker-bets poker-online popup-ads porn-tube "
             "porn-videos replica-watches sex-chat sexcam sexy-girls slots-win spam-links spam-mail spambot track-ads track-pixel tracker-pixel "
             "viagra-shop viagra-store warez-crack warez-keygen win-jackpot win-money win-prizes xxx-tube xxx-videos").split()
GOOD_NAMES = ("academy archive arthouse astronomy bakery biology birdwatch botany bridge builders chess choir cityhall clinic coding college cooking "
              "cycling dance daily dentist design docs economy engineer essays family farmers festival fishing forest forum gardening geology "
              "gazette handbook harbour health hiking history homebrew hospital howto journal kitchen knitting language law learning library "
              "literature local magazine maps maths medicine meteo motor mountain museum music nature news notes observatory opera orchestra "
              "parents parish philosophy photo physics poetry politics pottery press quilting radio railways recipes research river road sailing school "
              "science shipping society spring standard station stories sports teacher theatre theory thesis times tower trains travel "
              "university village weather weekly wiki winter woodwork writers zoology").split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, bad): each name under several tops, subdomains and paths, so that only the name tells the classes apart."""
    rows = []
    for bad, names in ((1, BAD_NAMES), (0, GOOD_NAMES)):
        for k, name in enumerate(names):
            for top, sub, path in (("example.com", "", f"en/{1000 + 7 * k}"), ("example.net", "www.", f"de/{20 + k}.html"), ("example.org", "m.", f"fr/{30000 + 11 * k}/"),
                                   ("com", "blog.", f"es/{400 + k}"), ("net", "", ""), ("org", "www.", f"en/{k}.html")):
                rows.append((f"https://{sub}{name}.{top}/{path}", bad))
    return spark.createDataFrame(rows, "url string, bad int")


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the n-grams of host and path."""
    found = set()
    for kind, text in (("h", f".{host}."), ("p", path.lower())):
        for n in SIZES:
            for i in range(len(text) - n + 1):
                found.add(zlib.crc32(f"{kind}{text[i:i + n]}".encode()) % BUCKETS)
    return np.fromiter(found, np.int64, len(found))


def train(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> np.ndarray | None:
    """Weights, bias last; None where the table lacks one of the classes."""
    rows = (labelled.filter("url is not null and bad is not null").orderBy(F.xxhash64("url"), "url").limit(max_labelled)
            .select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("bad").cast("double").alias("bad")).collect())
    y = np.array([r.bad for r in rows])
    if len(np.unique(y)) < 2:
        return None
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        g = grams(r.host, r.path)
        x[i, g] = len(g) ** -0.5
    weights = fit_logistic(x, y, ridge=2e-4, steps=300)
    # Shares of the classes in the table say nothing of the urls to judge: both count alike.
    weights[-1] += np.log((len(y) - y.sum()) / y.sum())
    return weights


def score(weights: np.ndarray, host: str, path: str) -> float:
    """Probability of a bad url."""
    g = grams(host, path)
    odds = weights[-1] + (weights[g].sum() * len(g) ** -0.5 if len(g) else 0.0)
    return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def best_rule(rules: dict, host: str, path: str) -> tuple[str, str] | None:
    """rules: host -> list of (path, verdict). The host itself, then what follows each of its dots."""
    best = None
    at = 0
    while host and at >= 0:
        suffix = host[at:]
        for start, verdict in rules.get(suffix, ()):
            if path.startswith(start) and (best is None or len(suffix) + len(start) > len(best[0])):
                best = (suffix + start, verdict)
        at = host.find(".", at) + 1 or -1
    return best


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame, threshold: float = 0.5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict (allow or block), score (the classifier's); one row per page.

    Without labels of both classes the classifier scores 0 and allows. Repeated rows and null ids stay as they are; other
    columns are not read.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host.lower(), []).append((path, verdict))
    sent = pages.sparkSession.sparkContext.broadcast((by_host, train(labelled, max_labelled)))

    @F.arrow_udf("struct<rule: string, verdict: string, score: double>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known, weights = sent.value
        for hosts, paths in batches:
            rule, verdict, scores = [], [], []
            for host, path in zip(hosts.to_pylist(), paths.to_pylist()):
                p = score(weights, host, path) if weights is not None and host else 0.0
                fits = best_rule(known, host, path)
                rule.append(fits[0] if fits else None)
                verdict.append(fits[1] if fits else "block" if p >= threshold else "allow")
                scores.append(p)
            yield pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(scores, pa.float64())], ["rule", "verdict", "score"])

    url = F.col("url")
    cut = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    return cut.withColumn("j", of.asNondeterministic()("host", "path")).select("page_id", "host", "path", "j.*")

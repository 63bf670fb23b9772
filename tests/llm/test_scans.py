"""License scan, line dedup and URL filter."""

import hashlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import types as T

from helixloom.llm import license_scan, line_dedup, url_filter

MIT = next(t for k, t in license_scan.NOTICES if k == "MIT" and len(t) > 300)


def scanned(df, licenses):
    return sorted((tuple(r) for r in license_scan.scan(df, licenses).select("doc_id", "license", "licenses", "n_lines").collect()), key=repr)


def test_licences_of_texts_and_lines(spark, documents, clash):
    rows = [(1, MIT), (2, MIT.replace("<year> <copyright holders>", "2020 Somebody").upper()), (3, MIT.replace("sublicense", "sub-license").replace(" (the \"Software\")", " (the Software)")),
            (4, MIT.replace("\n\n", "\n")), (5, MIT + "\nOne more line."), (6, "some text\nLICENSED UNDER THE APACHE LICENCE, VERSION 2.0\nmore"), (7, "Released under the MIT License"),
            (8, "All rights reserved."), (9, "text about a license"), (10, None), (11, ""), (12, "\n\n"), (None, "Licensed under CC BY-NC 4.0!"), (7, "Released under the MIT License"),
            (13, "(c) 2020 A\nReleased under the MIT Licence.\nAll rights reserved"), (14, "filler words\n" * 20_000 + "SPDX-License-Identifier: MIT")]
    want = [(1, "MIT", ["MIT"], 0), (2, "MIT", ["MIT"], 0), (3, "MIT", ["MIT"], 0), (4, "MIT", ["MIT"], 0), (5, None, [], 0), (6, None, ["Apache-2.0"], 1), (7, "MIT", ["MIT"], 1),
            (8, "LicenseRef-all-rights-reserved", ["LicenseRef-all-rights-reserved"], 1), (9, None, [], 0), (10, None, [], 0), (11, None, [], 0), (12, None, [], 0),
            (None, "CC-BY-NC-4.0", ["CC-BY-NC-4.0"], 1), (7, "MIT", ["MIT"], 1), (13, "MIT", ["LicenseRef-all-rights-reserved", "MIT"], 2), (14, None, ["MIT"], 1)]
    got = scanned(documents(rows, clash), license_scan.catalog(spark))
    # Rows equal in id and text share their lines' count.
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want, key=repr)]


def test_license_empty_tables(spark, documents):
    none = spark.createDataFrame([], "license string, text string")
    assert scanned(documents([(1, MIT)]), none) == [(1, None, [], 0)]
    assert scanned(documents([]), license_scan.catalog(spark)) == []


def templates(rows, min_docs=3, similarity=0.5, depth=3):
    """Plain version of the template tree."""
    lines = [(r, k, ["<*>" if re.search("[0-9]", t) else t for t in re.findall(r"[^\x20\x09-\x0D]+", line)]) for r, (_, text) in enumerate(rows) for k, line in enumerate((text or "").split("\n"))]
    lines = [(r, k, tuple(w)) for r, k, w in lines if w]
    docs = {}
    for r, _, w in lines:
        docs.setdefault(w, set()).add(r)
    held = {}
    for w, d in docs.items():
        for p, t in enumerate(w):
            held[len(w), w[:depth], p, t] = held.get((len(w), w[:depth], p, t), 0) + len(d)
    general, members = {}, {}
    for w in docs:
        const = [held[len(w), w[:depth], p, t] >= min_docs and t != "<*>" for p, t in enumerate(w)]
        varies = any(not c and t != "<*>" for c, t in zip(const, w))
        if varies and sum(const) / len(w) >= similarity:
            general[w] = (len(w), w[:depth], tuple(t if c else "<*>" for c, t in zip(const, w)))
            members.setdefault(general[w], set()).update(docs[w])
    drop = {w for w, d in docs.items() if len(d) >= min_docs or w in general and len(members[general[w]]) >= min_docs}
    out = []
    for r, (doc, text) in enumerate(rows):
        gone = {k for q, k, w in lines if q == r and w in drop}
        said = (text or "").split("\n")
        out.append((doc, len(said), len(gone), hashlib.sha256("\n".join(x for k, x in enumerate(said) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


LINES = [(1, "Posted here by anna on monday at noon\nReal words here\nPage 1 of 9"), (2, "Posted here by bert on monday at noon\nOther words\nPage 2 of 10"), (3, "Posted here by cleo on monday at noon\n\nPage 17 of 17"),
         (4, "Posted here by dora on friday at noon\nPosted here by x y z\n  Page\t4  of 5 "), (5, None), (6, ""), (7, "\n\n"), (8, "Subscribe now\nReal words here"), (9, "Subscribe now"), (None, "Subscribe now\nnull id"),
         (10, "same row\nSubscribe now"), (10, "same row\nSubscribe now"), (11, "a1b " * 3000 + "\nend"), (12, "Real words there"), (13, "Posted here by eve on monday at noon\nPosted here by eve on monday at noon")]


def test_lines_against_plain_version(documents, clash):
    df = line_dedup.annotate(documents(LINES, clash), min_docs=3)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == templates(LINES)


def test_line_dedup_text_and_empty(documents, clash):
    df = documents(LINES, clash)
    out = line_dedup.deduplicate(df, min_docs=3)
    assert out.columns == df.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[1] == "Real words here" and text[4] == "Posted here by dora on friday at noon\nPosted here by x y z" and text[5] is None and text[None] == "null id"
    assert line_dedup.annotate(documents([])).count() == line_dedup.deduplicate(documents([])).count() == 0


PAGE = T.StructType().add("page_id", T.LongType()).add("url", T.StringType()).add("html", T.StringType())
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


@pytest.mark.parametrize(("url", "host", "path", "rule"), [
    ("https://A.Example.COM/en/71?x", "a.example.com", "/en/71", "example.com/en/7"), ("http://example.com/en/8#y", "example.com", "/en/8", "com/en/"),
    ("http://badexample.com/en/7", "badexample.com", "/en/7", "com/en/"), ("x://net/de/", "net", "/de/", "net/de/"), ("x://w.example.net/de/8/", "w.example.net", "/de/8/", "example.net/de/8"),
    ("x://org?/es/", "org", "", None), ("x://h.org/ES/", "h.org", "/ES/", None), ("no scheme.org/es/", "", "", None), (None, "", "", None), ("", "", "", None), ("a://b://c/d", "b:", "//c/d", None), ("://", "", "", None)])
def test_hosts_paths_and_rules(spark, url, host, path, rule):
    df = spark.createDataFrame([(1, url, None)], PAGE)
    got = url_filter.judge(df, RULES, spark.createDataFrame([], "url string, bad int")).first()
    verdicts = {h + p: v for h, p, v in RULES}
    assert (got.host, got.path, got.rule, got.verdict) == (host, path, rule, verdicts.get(rule, "allow"))


def test_url_classifier_on_held_out_names(spark):
    rows = url_filter.labelled_urls(spark).collect()
    name = lambda u: re.sub(r"https://(www\.|m\.|blog\.)?", "", u).split(".")[0]
    held = {n for k, n in enumerate(sorted({name(r.url) for r in rows})) if k % 4 == 0}
    weights = url_filter.train(spark.createDataFrame([tuple(r) for r in rows if name(r.url) not in held], "url string, bad int"))
    tests = [(re.sub("^https://", "", r.url).partition("/"), r.bad) for r in rows if name(r.url) in held]
    right = np.mean([(url_filter.score(weights, h, "/" + p) >= 0.5) == bool(bad) for (h, _, p), bad in tests])
    assert right > 0.85


def test_urls_with_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://free-casino.example.org/a", None), (1, "http://free-casino.example.org/a", None), (None, "http://library.example.org/a", None)], PAGE)
    out = url_filter.judge(df.selectExpr("*", "1 AS host", "2 AS path", "3 AS rule", "4 AS verdict", "5 AS j"), RULES, url_filter.labelled_urls(spark)).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in out) == [(0, "allow"), (1, "block"), (1, "block")]
    assert url_filter.judge(df.limit(0), RULES, url_filter.labelled_urls(spark)).count() == 0


def test_document_of_many_dropped_lines(documents):
    word = lambda k: "".join("abcdefghij"[int(d)] for d in str(k))
    shared = lambda k: k % 3 > 0
    rows = [(i, "\n".join(f"{word(k)} stands here" if shared(k) else f"{word(k)} {word(i)} alone here" for k in range(20_000))) for i in range(12)]
    start = time.time()
    got = line_dedup.deduplicate(documents(rows), min_docs=10, similarity=1.1).orderBy("doc_id").collect()
    assert time.time() - start < 120
    assert [r.text for r in got] == ["\n".join(x for x in t.split("\n") if x.endswith("alone here")) for _, t in rows]

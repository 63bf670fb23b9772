"""Quality classifier, mixing, HTML extraction and the pipeline."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import types as T

from helixloom.llm import html_extract, mixing, quality

LABEL = T.StructType().add("doc_id", T.LongType()).add("quality", T.IntegerType()).add("toxic", T.IntegerType())


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 120))]
        bad = i % 4 == 0
        text = " ".join(w + "$$$" for w in words) if bad and i % 8 else (words[0] + " ") * len(words) if bad else " ".join(words).capitalize() + "."
        rows.append((i, text, "en", f"s{rng.randrange(4)}", len(text)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_quality_on_held_out_documents(spark, documents, clash):
    rows, labels = corpus(600)
    known = spark.createDataFrame(labels[:300], LABEL)
    got = {r.doc_id: r.keep for r in quality.annotate(documents(rows, clash), known, pool=150).collect()}
    right = [got[i] == bool(q) for i, q, _ in labels[300:]]
    assert np.mean(right) > 0.97
    assert all(got[i] for i, q, _ in labels[300:] if q)


def test_quality_edges(spark, documents, clash):
    rows, labels = corpus(200)
    extra = [(None, None, None, None, None), (900, "", None, "s1", 0), (901, "word " * 30_000, "en", None, None), (3, rows[3][1], "en", "s1", 1), (3, rows[3][1], "en", "s1", 1)]
    df = documents(rows + extra, clash)
    known = spark.createDataFrame(labels + [(5, None, 0), (None, 1, 0), (7, 0, 0)], LABEL)
    out = quality.annotate(df, known)
    assert out.count() == len(rows) + len(extra) and out.filter("score is null or keep is null").count() == 0
    kept = quality.keep_good(df, known)
    assert kept.columns == df.columns
    none = spark.createDataFrame([], LABEL)
    assert quality.keep_good(df, none).count() == df.count()
    assert quality.annotate(documents([]), known).count() == 0


def test_cotraining_guesses_over_all_documents(spark, documents):
    """Documents that no label covers teach the views, also a kind that is rarer than any sample of documents would show."""
    rows, labels = corpus(400)
    rare = [(1_000 + i, "zq zq zq zq " * 40 if i % 2 else rows[i + 1][1], "en", "rare", 0) for i in range(0, 24)]
    known = spark.createDataFrame(labels[:160] + [(300, None, 0)], LABEL)
    df = documents(rows + rare + [(None, "x", None, None, 0), (170, rows[170][1], "en", "s1", 0)])
    good = known.filter("quality is not null").select("doc_id", known.quality.cast("double").alias("y"))
    views, y, _ = quality._sampled(df, good.selectExpr("doc_id", "y", "-1 as v"))
    assert len(y) == 160 and not np.isnan(y).any()
    w = [quality.fit_logistic(v, y) for v in views]
    share = float(y.mean())
    (text, ty), (meta, my) = quality._spark_guesses(df, good, 10_000)(w, share, 9)
    # Without a bound to reach, the guesses are those of all unlabelled documents scored at hand; the repeated row counts in the quantiles.
    odds = {}
    for i, t, a, b, _ in rows[160:] + rare:
        odds[i] = [quality._score(quality.text_view(t.encode()), w[0]), quality._score(quality.meta_view(t.encode(), a, b), w[1])]
    for teacher, got in ((0, my), (1, ty)):
        ranked = sorted([o[teacher] for o in odds.values()] + [odds[170][teacher]])
        cut = ranked[math.ceil((1 - share) * len(ranked)) - 1]
        assert (got == 1).sum() == sum(o[teacher] >= max(cut, quality.SURE) for o in odds.values()) > 0
        assert (got == 0).sum() == sum(o[teacher] <= min(cut, -quality.SURE) for o in odds.values())
    few = quality._spark_guesses(df, good, 20)(w, share, 9)
    assert all(len(got) <= 21 for _, got in few)
    out = {r.doc_id: r.keep for r in quality.annotate(df, known).collect()}
    assert np.mean([out[i] == bool(q) for i, q, _ in labels[160:]]) > 0.95


def test_cotraining_learns_from_the_other_view():
    rng = np.random.default_rng(3)
    y = (np.arange(400) % 3 > 0).astype(float)
    text, meta = (np.stack([y + rng.normal(0, s, 400), rng.normal(0, 1, 400)], axis=1).astype(np.float32) for s in (0.25, 0.3))
    model = quality.cotrain([text[:300], meta[:300]], np.where(np.arange(300) < 24, y[:300], np.nan))
    assert np.mean((quality.judge(model, text[300:], meta[300:])[:, 2] >= 0.5) == y[300:]) > 0.93


def test_weights_meet_their_targets():
    shares = {"a": 0.7, "b": 0.2, "c": 0.07, "d": 0.03}
    for target in (0.8, 0.95, 1.0):
        w = mixing.weights_at(shares, mixing.exponent(shares, target_entropy=target))
        assert mixing.entropy(w) >= target * math.log(4) - 1e-9 and abs(sum(w.values()) - 1) < 1e-12
    w = mixing.weights_at(shares, mixing.exponent(shares, max_repeats=3.0))
    rates = [w[s] / shares[s] for s in shares]
    assert max(rates) / min(rates) == pytest.approx(3.0)
    assert mixing.exponent(shares, target_entropy=0.1) == 1.0 and mixing.exponent({"a": 1.0}, max_repeats=2.0) == 1.0
    assert mixing.plan({}, max_repeats=2.0) == []


MIX = [(i, "w " * (1 + i % 5), "en", "big" if i < 300 else f"s{i % 3}" if i < 390 else None) for i in range(400)]


def test_mix_realises_quotas(documents, clash):
    df = documents([(*m, 0) for m in MIX], clash).withColumnRenamed("n_chars", "mix")
    out = mixing.mix(df, budget=900, target_entropy=0.97).select("doc_id", "source", "mix.*").collect()
    tokens = {}
    for i, t, _, s in MIX:
        key = "null" if s is None else "=" + s
        tokens[key] = tokens.get(key, 0) + len(t.split())
    for source, total, weight, quota, epochs, rest in mixing.plan(tokens, 900, target_entropy=0.97):
        rows = [r for r in out if ("null" if r.source is None else "=" + r.source) == source]
        used = sum(r.tokens for r in rows)
        # A running sum stops at the first document of one block that would pass the quota.
        assert quota - 5 <= used <= quota
        for epoch in range(epochs):
            assert sum(r.tokens for r in rows if r.epoch == epoch) == total
        assert len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
        assert all(r.weight == pytest.approx(weight) for r in rows)


def test_mix_edges(documents):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "x y", "en", "a"), (3, "x y", "en", "a"), (None, "z", "en", "b"), (4, None, "en", "empty")]
    out = mixing.mix(documents([(*r, 0) for r in rows]), max_repeats=2.0).collect()
    assert {(r.doc_id, r.text) for r in out} == {(r[0], r[1]) for r in rows}
    assert mixing.mix(documents([]), max_repeats=2.0).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(documents([]))


def test_minimum_cut_against_all_labellings():
    rng = random.Random(8)
    for _ in range(150):
        n = rng.randrange(1, 9)
        costs = [rng.uniform(-2, 2) for _ in range(n)]
        near = {i: {} for i in range(n)}
        for a, b in itertools.combinations(range(n), 2):
            if rng.random() < 0.5:
                near[a][b] = near[b][a] = rng.uniform(0, 1.5)

        def cost(label):
            return sum(max(c, 0) if not x else max(-c, 0) for c, x in zip(costs, label)) + sum(c for a in near for b, c in near[a].items() if a < b and label[a] != label[b])

        assert cost(html_extract.minimum_cut(costs, near)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


PAGES = [
    ("<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>First  paragraph\nwith <b>bold</b> text that goes on for a while.<p>Second one, &eacute;t&#233;, is short.</article>"
     "<footer>&copy; 2020 someone</footer></body></html>", "A & B\nFirst paragraph with bold text that goes on for a while.\nSecond one, été, is short."),
    ("<body><div class='cookie-notice'>We use cookies on this site to make it work better for you all.</div><div id=main><p>The text of this page is long enough to be kept as main text.</p>"
     "<div class=ad><p>Buy this thing now because it is the best thing that there ever was.</p></div><p>And it goes on after the advert with another sentence of some length.</p></div>"
     "<aside><p>Other stories that one could read on this site, with quite a few words.</p></aside><section class='comments'><p>I read this and I think that it is very good indeed, thanks.</p></section>",
     "The text of this page is long enough to be kept as main text.\nAnd it goes on after the advert with another sentence of some length."),
    ("<article><p>Kept text before the form is here, with enough words in it.</p><form><label>Name</label><p>Please leave your name and address with us here.</p></form><script>var a='<p>no</p>'</script>"
     "<style>p{}</style><!-- <p>no</p> --><table><tr><td>1<td>2</tr></table></article>", "Kept text before the form is here, with enough words in it.\n1 2"),
    ("", ""), (None, ""), ("<p", ""), ("<nav>Menu</nav>", ""), ("<article><p>Cut off in the mid", "Cut off in the mid"), ("<article><p>a < b &lt;c&gt; and it stays so.</p><script>never closed <p>x", "a < b <c> and it stays so."),
]


def test_pages(spark):
    shape = T.StructType().add("page_id", T.LongType()).add("url", T.StringType()).add("html", T.StringType())
    df = spark.createDataFrame([(i, f"u{i}", p) for i, (p, _) in enumerate(PAGES)] + [(None, None, PAGES[0][0])] * 2, shape).selectExpr("*", "1 AS text", "2 AS n_chars")
    got = html_extract.extract(df).collect()
    assert sorted((r.page_id, r.text) for r in got if r.page_id is not None) == [(i, t) for i, (_, t) in enumerate(PAGES)]
    assert all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id is None] == [PAGES[0][1]] * 2
    assert html_extract.extract(df.limit(0)).count() == 0


def test_page_of_many_blocks():
    paragraphs = [f"Paragraph number {i} says something of a certain length here." for i in range(3000)]
    page = "<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>"
    assert html_extract.main_text(page) == "\n".join(paragraphs)
    soup = "<body>" + "".join(f"<div>{'word ' * (i % 9)}</div>" for i in range(3000))
    assert isinstance(html_extract.main_text(soup), str)


SAID = "<p>The first sentence of the story is long enough to be read as a sentence.<p>A second one goes on from there for a while.<p>A third ends it."


@pytest.mark.parametrize("names", ["post has-comments", "post category-legal", "hentry tag-search", "post type-post comments-open", "entry-content no-related",
                                   "social-science story", "legal-history"])
def test_a_word_in_a_name_does_not_empty_an_article(names):
    want = SAID[3:].replace("<p>", "\n")
    assert html_extract.main_text(f"<body><nav class=menu><a href=/>Home</a></nav><article class='{names}'>{SAID}</article><footer>About us</footer>") == want
    assert html_extract.main_text(f"<body><article><section id='search-methods'>{SAID}</section></article>") == want


@pytest.mark.parametrize("names", ["comment", "comment-body", "post ad", "related", "sponsored"])
def test_comments_and_adverts_that_are_articles_go(names):
    main = f"<article class=post>{SAID}</article>"
    assert html_extract.main_text(f"<body>{main}<article class='{names}'><p>Other words stand here, and there are quite many of them, too.</article>") == SAID[3:].replace("<p>", "\n")


def test_broken_markup_takes_linear_time_and_swallows_nothing():
    text = html_extract.main_text(f"<body><article>{SAID}<select><option>a<p>The fourth sentence stands after a list without an end.</article>")
    assert text.endswith("The fourth sentence stands after a list without an end.") and text.startswith("The first")
    for page in ("<div>" * 50_000 + "</b>" * 50_000, "<span>" * 50_000 + "a<br>" * 50_000, "<select>" * 50_000, "<div>" * 50_000 + "<li></li>" * 50_000):
        start = time.process_time()
        html_extract.main_text(page)
        assert time.process_time() - start < 10

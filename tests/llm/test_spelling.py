"""Spelling variants against a comparison of all pairs."""

from __future__ import annotations

import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from helixloom.llm import spelling


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(words: dict[str, int]) -> list[tuple]:
    form = {}
    links = {w: [o for o in words if o != w and near(w, o)] for w in words}
    for w, n in words.items():
        best = min(links[w], key=lambda o: (-words[o], o), default=None)
        if best and words[best] >= 10 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(links[w]), words[form[w]] if w in form else None))
    return sorted(out)


def rows(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@settings(max_examples=300, deadline=None)
@given(st.text("abé", min_size=7, max_size=9), st.text("abé", min_size=7, max_size=9))
def test_one_edit_is_one_edit(a, b):
    assert (spelling.one_edit(a, b) if len(a) <= len(b) else spelling.one_edit(b, a)) == (abs(len(a) - len(b)) <= 1 and a != b and near(a, b))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcdé", min_size=7, max_size=8), min_size=1, max_size=40, unique=True), st.text("abcdé", min_size=7, max_size=8))
def test_trie_misses_no_word_within_the_budget(words, asked):
    vectors = [spelling.vector(w) for w in words]
    trie = spelling.VectorTrie(vectors)
    for i in range(len(words)):
        trie.add(i)
    found = set(trie.search(spelling.vector(asked), 1, 1))
    for i, w in enumerate(words):
        if w == asked or near(w, asked):
            assert i in found


def test_words_like_all_pairs(spark):
    letters = "abc"
    words = {}
    for k in range(1500):
        h = zlib.crc32(str(k).encode())
        words["".join(letters[(h >> (2 * i)) % 3] for i in range(7 + h % 3))] = 2 + h % 7 * (300 if h % 11 == 0 else 1)
    words |= {"éàüöñçß": 4, "éàüöñç": 90, "éàüöñçßa": 900, "straße": 50}
    words = {w: n for w, n in words.items() if len(w) >= 7}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(spelling.group_variants(df)) == plain(words)


def test_a_shard_cut_by_the_top_of_its_trie_gives_the_same_pairs(spark):
    words = {"prefix" + "".join("abcdefghijkl"[(k * p) % 12] for p in (1, 5, 7)) + x: 2 + k % 9 for k in range(144) for x in ("", "q", "mn")}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    whole, cut = (sorted(map(tuple, spelling.near_words(df, shard=size).collect())) for size in (10_000, 4))
    assert whole == cut and whole


def test_dented_runs_and_empty_input(spark):
    docs = spark.createDataFrame([(1, "Variants variants"), (2, None), (None, "Éclairs éclairs éclairs x" + "y" * 100_000), (4, ""), (4, "")], "doc_id long, text string")
    counts = {}
    for doc_id, text in ((1, "variants variants"), ("", "Éclairs éclairs éclairs x" + "y" * 100_000)):
        for run in text.split():
            word = spelling.dented(str(doc_id), run)
            counts[word] = counts.get(word, 0) + 1
    expected = {w: n for w, n in counts.items() if n > 1 and len(w) > 6}
    assert {r["word"]: r["n"] for r in spelling.annotate(docs.withColumn("word", docs.text)).collect()} == expected
    assert spelling.annotate(docs.filter("false")).count() == 0

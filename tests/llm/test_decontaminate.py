import hashlib
import random
import re

from helixloom.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, size=10):
    out = []
    for doc, text in rows:
        w, hit, names = words(text), set(), set()
        for item, told in items:
            p = words(told)
            m = min(size, len(p))
            for a in range(len(p) - m + 1 if p else 0):
                for i in range(len(w) - m + 1):
                    if w[i:i + m] == p[a:a + m]:
                        hit.update(range(i, i + m))
                        if item is not None:
                            names.add(str(item))
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


ITEMS = [(1, "The quick, brown fox jumps over the lazy dog and runs far away today"), (2, "Hello world"), (10, "x"), (3, ""), (4, None), (5, "... ---"),
         (6, "a a a a a a a a a a a a"), (2, "hello WORLD again"), (None, "nameless pattern of four"), (7, "Ünïcode wörds stay whole"), (11, "x")]
DOCS = [(1, "so THE quick brown fox jumps over the lazy dog and runs home"), (2, "the quick brown fox jumps over the lazy dog"), (3, "say hello-world again!"),
        (4, None), (5, ""), (6, "a " * 40), (7, "a b x y"), (8, "this nameless pattern of four words"), (None, "hello world"), (9, "ünïcode Wörds ünïcode wörds stay whole"),
        (9, "x"), (9, "x"), (12, "filler " * 30_000 + "hello world " + "filler " * 10)]


def test_rows_against_brute_force(spark, documents, clash):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [r for r in DOCS if r[0] != 12]
    assert result(decontaminate.annotate(documents(rows, clash), bench)) == brute(rows, ITEMS)
    long = decontaminate.annotate(documents(DOCS[-1:]), bench).first()
    assert (long.n_words, long.n_hit, long.n_items) == (30_012, 2, 1)


def test_random_words_in_one_and_many_blocks(spark, documents):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["aa", "b", "cc", "d"]) for _ in range(n))
    items = [(i, text(rng.randrange(1, 16))) for i in range(25)]
    rows = [(i, text(rng.randrange(60))) for i in range(120)] + [(5, "same"), (5, "same")]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), documents(rows)
    want = brute(rows, items)
    assert result(decontaminate.annotate(docs, bench)) == want
    assert result(decontaminate.annotate(docs, bench, block_words=300)) == want


def test_shifts_skip_but_lose_nothing():
    tables = decontaminate.build_tables([("a", b"one two three four five six seven eight nine ten eleven")])
    (length, size, far, shift, buckets), = tables["searches"]
    assert (length, size, far) == (10, 3, 8) and min(shift.values()) == 0 and max(shift.values()) == 7 and len(buckets) == 2
    spans, names = decontaminate.search(tables, b"zero one two three four five six seven eight nine ten eleven twelve".split())
    assert spans == [(1, 12)] and names == {"a"}


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.annotate(documents([]), none).count() == 0
    assert result(decontaminate.annotate(documents([(1, "a b")]), none)) == brute([(1, "a b")], [])
    assert decontaminate.clean(documents([]), none).count() == 0


def test_clean_keeps_all_columns(spark, documents, clash):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = documents(DOCS, clash)
    out = decontaminate.clean(df, bench)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 4, 5, 9]  # Ü and ü differ: only A-Z are lower-cased
    assert decontaminate.clean(df, bench, block_words=40).count() == out.count()

import hashlib
import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helixloom.llm import substring_dedup


def brute(rows, size):
    first = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = [d if d is not None else 1 << 62 for d, _ in rows]
    for d, w in zip(order, split):
        for i in range(len(w) - size + 1):
            key = tuple(w[i:i + size])
            first[key] = min(first.get(key, d), d)
    out = []
    for (doc, _), d, w in zip(rows, order, split):
        gone = {k for i in range(len(w) - size + 1) if first[tuple(w[i:i + size])] < d for k in range(i, i + size)}
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def passages(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") * rng.randrange(1, 4)
    shared = [[word() for _ in range(rng.randrange(50, 140))] for _ in range(6)]
    rows = []
    for i in range(60):
        text = [word() for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            p = list(rng.choice(shared))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit"
            a = rng.randrange(20)
            text += p[a:] + [word() for _ in range(rng.randrange(30))]
        rows.append((rng.randrange(1000), rng.choice(["  ", " ", "\n"]).join(text)))
    return rows


EDGE = [(None, "w " * 70), (2000, "w " * 60), (2001, None), (2002, ""), (2003, "x y z"), (2004, "é " * 51), (2005, "é " * 50), (2006, "E " * 50),
        (2007, " ".join(map(str, range(200)))), (2007, " ".join(map(str, range(200)))), (2007, " ".join(map(str, range(100, 300)))), (2008, " ".join(map(str, range(120, 180)))),
        (1999, " ".join(str(i % 7) for i in range(400))), (2009, " ".join(str((i + 3) % 7) for i in range(90)))]


def test_rows_against_brute_force(documents, clash):
    rows = passages() + EDGE
    assert result(substring_dedup.annotate(documents(rows, clash))) == brute(rows, 50)


def test_contents_that_repeat_inside_their_first_document(documents):
    # Document 5 holds its own passage twice; an earlier one holds only the middle, behind another beginning.
    core = [f"c{i}" for i in range(60)]
    rows = [(1, " ".join(["p"] * 9 + core + ["q"] * 9)), (5, " ".join(["r"] * 40 + core + ["s"] * 40 + ["r"] * 40 + core + ["s"] * 40)), (9, " ".join(["r"] * 40 + core))]
    assert result(substring_dedup.annotate(documents(rows))) == brute(rows, 50)


def test_long_text_is_cut_into_pieces(documents, monkeypatch):
    rows = [(1, " ".join(str(i) for i in range(3000))), (2, " ".join(str(i) for i in range(700, 3500)))]
    for window, gram in ((50, 12), (8, 12)):
        want = brute(rows, window)
        assert result(substring_dedup.annotate(documents(rows), window, gram)) == want


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=24), min_size=1, max_size=12))
def test_few_words_many_repeats(documents, texts):
    rows = [(i // 2, " ".join(t)) for i, t in enumerate(texts)]
    assert result(substring_dedup.annotate(documents(rows), 6, 3)) == brute(rows, 6)


def test_pieces_join(monkeypatch):
    import numpy as np

    h = np.random.default_rng(1).integers(0, 50, 5000).astype(np.uint64)
    whole = [np.concatenate(c) for c in zip(*substring_dedup.blocks(h))]
    monkeypatch.setattr(substring_dedup, "PIECE", 700)
    parts = [np.concatenate(c) for c in zip(*substring_dedup.blocks(h))]
    assert whole[3].sum() == parts[3].sum() == 5000 - 49 and len(parts[3]) <= len(whole[3]) + 7


def test_deduplicate_and_empty(documents, clash):
    rows = [(1, " ".join(map(str, range(80)))), (2, "a  b " + " ".join(map(str, range(10, 80)))), (3, "left  as\nit is"), (4, None)]
    df = documents(rows, clash)
    out = substring_dedup.deduplicate(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text) == [(1, rows[0][1]), (2, "a b"), (3, "left  as\nit is")]
    assert substring_dedup.annotate(documents([])).count() == substring_dedup.deduplicate(documents([])).count() == 0

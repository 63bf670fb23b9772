import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from helixloom.llm import simhash


def plain_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=2):
    prints = [plain_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[find(i)] = min(ids.get(find(i), doc), doc)
    return sorted(((doc, f"{prints[i]:016x}", ids.get(find(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def near_copies(n, seed=5, words=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    rows = []
    for i in range(n):
        text = list(base) if i % 3 else [rng.choice(vocabulary) for _ in range(words)]
        if i % 2:
            text[rng.randrange(words)] = rng.choice(vocabulary)
        rows.append((i, " ".join(text)))
    return rows


EDGE = [(None, "One two three four"), (50, "one TWO three four"), (51, None), (52, ""), (53, " \n"), (54, "É one"), (55, "é one"), (56, "one"), (57, "One"),
        (58, "same row here now"), (58, "same row here now"), (None, "no other like it"), (59, "w " * 60_000)]


def test_rows_against_brute_force(documents, clash):
    rows = near_copies(150) + EDGE
    assert result(simhash.annotate(documents(rows, clash))) == brute(rows)


def test_empty_table(documents):
    assert simhash.annotate(documents([])).count() == 0
    assert simhash.deduplicate(documents([])).count() == 0


def test_split_shards_link_the_same(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(5)]
    prints = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(120)})
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "print long")

    def groups(shard):
        rows = simhash.components(simhash.links(df, 2, shard)).collect()
        members = {}
        for r in rows:
            members.setdefault(r.root, {r.root}).add(r.node)
        return sorted(map(sorted, members.values()))

    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 2:
                root[find(p)] = find(q)
    want = {}
    for p in prints:
        want.setdefault(find(p), []).append(int(np.uint64(p).astype(np.int64)))
    want = sorted(sorted(v) for v in want.values() if len(v) > 1)
    assert groups(2048) == want
    assert groups(16) == want


def test_tree_search_finds_all_within_radius():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 12, 300).astype(np.uint64)
    tree = simhash.BKTree(prints)
    for radius in (0, 2, 4):
        found = {(node, int(q)) for node, near in tree.search(prints, radius) for q in near}
        # Equal fingerprints share a node: only the first of them is in the tree.
        nodes = {n for n, _ in found}
        want = {(n, q) for n in nodes for q in range(300) if int(prints[n] ^ prints[q]).bit_count() <= radius}
        assert found == want and {int(prints[n]) for n in nodes} == set(prints.tolist())


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_copies_of_five_word_shingles(documents):
    """Recall of the wide radius against brute force over pairs of four fifths similarity or more; no other text goes."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, copies = [], []
    for i in range(300):
        base = [word() for _ in range(rng.randrange(60, 300))]
        rows.append((2 * i, " ".join(base)))
        if i % 2:
            other = list(base)
            for _ in range(max(1, len(base) // 60)):
                other[rng.randrange(len(other))] = word()
            rows.append((2 * i + 1, " ".join(other)))
            a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
            if len(a & b) / len(a | b) >= 0.82:
                copies.append(2 * i + 1)
    rows += [(10_000 + i, f"short text {word()} of few words {word()}") for i in range(200)]
    gone = {i for i, _ in rows} - {r.doc_id for r in simhash.deduplicate(documents(rows)).collect()}
    assert len(gone & set(copies)) >= 0.9 * len(copies) > 90
    assert all(g % 2 and g < 10_000 for g in gone)


def test_shingles_of_long_texts_come_in_runs():
    words = [str(i % 9_000) for i in range(120_000)]
    runs = list(simhash.shingle_hashes(" ".join(words).encode(), 5))
    assert len(runs) == 3 and sum(map(len, runs)) == len(words) - 4
    assert runs[1][0] == xxhash.xxh64_intdigest(" ".join(words[51_000:51_005]).encode(), 42)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(400)], "a long, b long")
    assert simhash.components(edges).select(F.countDistinct("node"), F.max("root")).first()[:] == (400, 0)


def test_deduplicate_keeps_one_of_each_group(documents, clash):
    rows = near_copies(40) + EDGE
    df = documents(rows, clash)
    out = simhash.deduplicate(df, shingle=3, radius=2, similarity=None)
    assert out.columns == df.columns
    want = {c for _, _, c in brute(rows)}
    got = [r.doc_id for r in out.collect()]
    assert set(got) == want and len(got) == len(want)


def kept_by_brute(rows, similarity=0.8):
    """Smallest ids of the components of all pairs with the similarity, compared one by one."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return set(least.values())


def kept_by_stage(documents, rows):
    got = [r.doc_id for r in simhash.deduplicate(documents(rows)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def variants(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.randint(*edits)):
            text[rng.randrange(words)] = f"e{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(text)))
    return rows


def test_links_that_fail_do_not_hide_pairs_that_hold(documents):
    rows = variants(400, 200, (1, 8), 3)
    want = kept_by_brute(rows)
    assert 20 < len(want) < 380
    assert kept_by_stage(documents, rows) == want


def test_pairs_near_the_threshold_at_any_distance_of_fingerprints(documents):
    rows, far = [], 0
    for k in range(250):
        pair = [t for _, t in variants(2, 60 + k, ((60 + k) // 90, (60 + k) // 70 + 1), k)]
        rows += [(2 * k, pair[0]), (2 * k + 1, pair[1])]
        a, b = map(shingles, pair)
        far += len(a & b) / len(a | b) >= 0.8 and (plain_print(pair[0], 5) ^ plain_print(pair[1], 5)).bit_count() > 12
    want = kept_by_brute(rows)
    assert far > 3 and len(want) < 450
    assert kept_by_stage(documents, rows) == want


def test_equal_fingerprints_of_unlike_texts_stay(documents):
    words = lambda i: " ".join(f"u{i}x{k}" for k in range(60))
    rows = [(i, words(i) + "\n" + "\n".join(["to be read once more"] * 60)) for i in range(6)]
    rows += [(10, rows[2][1].upper()), (11, rows[3][1] + " more")]
    assert len({plain_print(t, 5) for _, t in rows[:6]}) == 1
    assert kept_by_stage(documents, rows) == set(range(6))


def test_parts_of_a_common_shingle_tell_the_same_pairs(spark):
    rng = random.Random(2)
    sets = [sorted(rng.sample(range(30), rng.randint(8, 12))) for _ in range(300)]
    keys = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "node long, set array<bigint>")
    moved = spark.createDataFrame([(i, i % 7) for i in range(7, 40)], "node long, root long")
    root = lambda i: i % 7 if 7 <= i < 40 else i
    want = {(i, j) for j in range(300) for i in range(j) if root(i) != root(j)
            and len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= 0.5}
    for shard in (2048, 16):
        pairs = simhash.unmet(keys, moved, 0.5, shard)
        assert want <= {tuple(r) for r in pairs.distinct().collect()}
        assert {tuple(r) for r in simhash.confirmed(pairs, keys, 0.5).collect()} == want


def test_upper_bound_of_the_overlap_loses_no_pair(spark):
    rng = random.Random(5)
    sets = []
    for k in range(60):
        core = {rng.getrandbits(63) - (1 << 62) for _ in range(20 + 7 * k)}
        for share in (0.0, 0.05, 0.1, 0.12, 0.3):
            gone = set(rng.sample(sorted(core), int(share * len(core))))
            sets.append(sorted(core - gone | {rng.getrandbits(63) for _ in range(rng.randint(0, len(gone)))}))
    sets += [[], [1], [2]]
    keys = spark.createDataFrame(list(enumerate(sets)), "node long, set array<bigint>")
    pairs = [(5 * k + i, 5 * k + j) for k in range(60) for j in range(5) for i in range(j)] + [(5 * k, 5 * k + 5) for k in range(59)] + [(300, 301), (301, 302)]
    want = {(i, j) for i, j in pairs if sets[i] and len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= 0.8}
    asked = spark.createDataFrame(pairs, "a long, b long")
    open_pairs = {tuple(r) for r in simhash._hopeful(asked, keys, 0.8).collect()}
    assert 100 < len(want) and want <= open_pairs and len(open_pairs - want) < len(set(pairs) - want) / 2
    assert {tuple(r) for r in simhash.confirmed(asked, keys, 0.8).collect()} == want

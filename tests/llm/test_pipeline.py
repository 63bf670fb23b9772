"""The pipeline on the smallest table: each stage against what it may do, and the whole against its parts."""

import re

import pytest
from test_simhash import plain_print

import corpus_pipeline
from helixloom.llm import mixing, quality, simhash
from helixloom.llm.decontaminate import words_of


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, sf).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns_stay(stages):
    assert all(after.columns == before.columns for before, after in stages[:-1])
    assert stages[-1][1].columns == [*stages[-1][0].columns, "mix"]


def test_clean_labelled_documents_stay(spark, sf, stages):
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    before, after = ({r.doc_id for r in d.select("doc_id").collect()} for d in stages[0])
    assert good & before <= after and after < before


def test_exact_copies_go(stages):
    before, after = ([(r.doc_id, re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), -len(r.text or "")) for r in d.collect()] for d in stages[1])
    best = {}
    for i, t, n in before:
        best[t] = min(best.get(t, (n, i)), (n, i))
    assert sorted(i for i, _, _ in after) == sorted(i for _, i in best.values())


def test_near_copies_go_and_others_stay(stages):
    before, after = ({r.doc_id: r.text or "" for r in d.collect()} for d in stages[2])
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for i, t in before.items() for w in [t.lower().split()]}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    ids = sorted(before)
    pairs = [(a, b) for k, b in enumerate(ids) for a in ids[:k] if sets[a] & sets[b] and alike(a, b) >= 0.8]
    assert set(before) - set(after) <= {b for _, b in pairs}
    # Of every pair at four fifths or more, at any distance of fingerprints, one goes.
    missed = [(a, b) for a, b in pairs if a in after and b in after]
    assert pairs and not missed
    assert all(plain_print(before[a]) != plain_print(before[b]) for a, b in missed)


def test_benchmark_passages_go(spark, sf, stages):
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words_of((r.text or "").encode())
        windows |= {tuple(w[k:k + 10]) for k in range(max(0, len(w) - 10) + 1)} if w else set()
    sizes = {len(w) for w in windows}
    before, after = ({r.doc_id: words_of((r.text or "").encode()) for r in d.collect()} for d in stages[3])
    hit = {i for i, w in before.items() if any(tuple(w[k:k + m]) in windows for m in sizes for k in range(len(w) - m + 1))}
    assert set(after) == set(before) - hit


def test_mix_uses_every_document_and_its_quota(stages):
    before, after = stages[4]
    tokens = {}
    for r in before.collect():
        tokens["=" + r.source] = tokens.get("=" + r.source, 0) + len((r.text or "").split())
    used = {}
    for r in after.collect():
        used["=" + r.source] = used.get("=" + r.source, 0) + r.mix.tokens
    longest = max(len((r.text or "").split()) for r in before.collect())
    for source, _, _, quota, _, _ in mixing.plan(tokens, max_repeats=2.0):
        assert quota - longest <= used[source] <= quota
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}


def test_run_is_its_stages(spark, sf, stages):
    key = lambda d: sorted((r.doc_id, r.mix.epoch) for r in d.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(stages[-1][1])


def test_stages_bound_their_batches_by_themselves(spark, documents, tmp_path, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name, None)
    keep = {"quality": quality.stored, "simhash": simhash.stored}
    for module in (quality, simhash):
        def told(df, what, module=module):
            seen.append((module.__name__.rsplit(".", 1)[1], spark.conf.get(name, None)))
            return keep[seen[-1][0]](df, what)

        monkeypatch.setattr(module, "stored", told)
    docs = documents([(i, " ".join(f"w{i * i}x{k}" for k in range(20 + i % 9))) for i in range(40)])
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for label, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, str(tmp_path)).count() <= 40
        assert spark.conf.get(name, None) == before, label
    assert {m for m, _ in seen} == {"quality", "simhash"} and {size for _, size in seen} == {"4m"}


def test_decontamination_sends_small_batches_whoever_writes_its_result(spark, documents, tmp_path, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, keep = spark.conf.get(name, None), corpus_pipeline.stored

    def told(df, what):
        seen.append(spark.conf.get(name, None))
        return keep(df, what)

    monkeypatch.setattr(corpus_pipeline, "stored", told)
    passage = " ".join(f"q{k}" for k in range(12))
    docs = documents([(1, f"x {passage} y"), (2, "x y z"), (2, "x y z"), (None, None), (4, passage[:20])])
    spark.createDataFrame([(7, passage), (8, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    label, stage = corpus_pipeline.STAGES[3]
    out = stage(spark, docs, str(tmp_path))
    assert seen == ["4m"] and spark.conf.get(name, None) == before, label
    # No text is sent to Python by the plan that the caller writes.
    assert "ArrowEvalPython" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, (r.doc_id for r in out.collect()))) == ["2", "2", "4", "None"]

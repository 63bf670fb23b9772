"""What Python workers keep between tasks, and what readers decode at a time."""

import ctypes
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixloom.llm import exact_dedup, quality, simhash
from helixloom.llm.common import give_back, small_batches

linux = pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists() or not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="needs Linux with glibc")


def meter():
    """A function for workers, sent by value: MB that its worker could give back, by the tools that do it."""

    def still_free(batches):
        import ctypes
        import re
        from pathlib import Path

        import pyarrow as pa

        def held():
            return sum(map(int, re.findall(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

        for _ in batches:
            pass
        before = held()
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
        yield pa.RecordBatch.from_arrays([pa.array([before - held()])], ["mb"])

    return still_free


@linux
@pytest.mark.parametrize("work", ["quality", "shingle sets", "digests"])
def test_idle_workers_keep_little(spark, tmp_path, work):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(150)), lambda x: F.sha2(F.concat_ws("-", "doc_id", x), 256)))
    docs = spark.range(0, 8_000, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"))
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    out = {
        "quality": lambda: quality._log_odds(docs, [np.ones(quality.GRAMS + 3, np.float32), np.ones(quality.NAMES + 10, np.float32)]),
        "shingle sets": lambda: docs.select(simhash.shingle_sets(F.col("text"), 5).alias("s")),
        "digests": lambda: docs.select(exact_dedup.text_digest(F.col("text")).alias("d")),
    }[work]()
    out.write.format("noop").mode("overwrite").save()
    cores = spark.sparkContext.defaultParallelism
    kept = [r.mb for r in spark.range(0, 4 * cores, 1, 4 * cores).mapInArrow(meter(), "mb double").collect()]
    assert max(kept) < 12, sorted(kept)[-8:]


def test_give_back_keeps_what_is_in_use():
    kept = pa.array(np.arange(1_000_000)), np.arange(1_000_000)
    give_back()
    assert kept[0].to_numpy()[-1] == kept[1][-1] == 999_999


def test_small_batches_bound_readers_and_restore(spark):
    names = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(n, None) for n in names]
    with small_batches(spark):
        assert [spark.conf.get(n) for n in names] == ["4m", "512"]
    assert [spark.conf.get(n, None) for n in names] == before
    spark.conf.set(names[1], "1024")
    try:
        with pytest.raises(ValueError), small_batches(spark):
            raise ValueError
        assert spark.conf.get(names[1]) == "1024"
    finally:
        spark.conf.set(names[1], before[1]) if before[1] else spark.conf.unset(names[1])

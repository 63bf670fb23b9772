"""Words, shared tables and small numeric helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters of [\x20\x09-\x0D]; bytes.split() without an argument splits on exactly these.
WHITE = b" \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and go on from the table, which cuts the lineage.

    Whoever stores a table gives it up with `released` once all its readers are stored themselves.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Remove the files of stored tables that nothing reads any more.

    Shuffle files of the plans that wrote them go once the driver has collected those plans, which is asked for here.
    """
    for table in tables:
        jvm = table.sparkSession._jvm
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    if tables:
        tables[0].sparkSession._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m", rows: int = 512) -> Iterator[None]:
    """Python workers of plans that run inside get their rows in Arrow batches of about this size (at least one row each).

    Readers of Parquet files decode that many rows at a time: 4096 rows of long texts or shingle sets are tens of megabytes a column.
    """
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": size, "spark.sql.parquet.columnarReaderBatchSize": str(rows)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def give_back() -> None:
    """Memory that this Python process has freed goes back to the system.

    Spark keeps a Python worker for later tasks, several of them a core where a plan has several functions, and an idle one holds
    what its last batch took.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(batches: Iterator) -> Iterator:
    """The batches of a task. At their end memory is given back, with the last batch if whoever reads them has let go of it."""
    for batch in batches:
        yield batch
        batch = None
    give_back()


def packed(df: DataFrame, *named: tuple[str, F.Column]) -> DataFrame:
    """Whole rows in one column `row`, beside working columns: no name of the input can clash with those."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in named])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def texts(column: pa.Array, step: int = 256) -> Iterator[bytes]:
    """UTF-8 texts of an Arrow column, a few at a time; null is empty."""
    as_bytes = column.cast(pa.binary())
    for at in range(0, len(as_bytes), step):
        for text in as_bytes.slice(at, step).to_pylist():
            yield text or b""


def pieces(batches: Iterator[pa.Array], step: int = 512) -> Iterator[pa.Array]:
    """Arrow columns in pieces of few rows, for functions whose results are as long as their texts."""
    for column in batches:
        for at in range(0, len(column), step):
            yield column.slice(at, step)
        column = None


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights (bias last) of a logistic regression: accelerated gradient on a bounded sample of rows, in x's precision."""
    n, dims = x.shape
    y = y.astype(x.dtype)

    def pulled(r: np.ndarray) -> np.ndarray:
        return np.append(r @ x, r.sum())

    # A bound on the curvature gives the step; the largest singular value comes from a few power steps.
    v, size = np.full(dims + 1, (dims + 1) ** -0.5, x.dtype), 1.0
    for _ in range(12):
        u = pulled(x @ v[:-1] + v[-1])
        size = float(np.linalg.norm(u)) or 1.0
        v = (u / size).astype(x.dtype)
    step = 1.0 / (0.25 * 1.05 * size / n + ridge)
    w, look = np.zeros(dims + 1), np.zeros(dims + 1)
    for t in range(steps):
        odds = x @ look[:-1].astype(x.dtype) + x.dtype.type(look[-1])
        p = 1.0 / (1.0 + np.exp(-np.clip(odds, -30, 30)))
        new = look - step * (pulled(p - y) / n + ridge * np.append(look[:-1], 0.0))
        look = new + (t / (t + 3.0)) * (new - w)
        w = new
    return w

import pytest
from pyspark.sql import types as T

DOC = T.StructType().add("doc_id", T.LongType()).add("text", T.StringType()).add("lang", T.StringType()).add("source", T.StringType()).add("n_chars", T.LongType())


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """Tests have one machine: the session gets a shared folder of its own."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('shared')}")


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) or longer tuples; clash adds columns with names the operators use inside."""

    def make(rows, clash=()):
        full = [tuple(r) + ("en", "a", None)[len(r) - 2:] if len(r) < 5 else tuple(r) for r in rows]
        df = spark.createDataFrame(full, DOC)
        for name in clash:
            df = df.selectExpr("*", f"doc_id AS `{name}`")
        return df

    return make


CLASH = ("kept", "row", "h", "doc", "digest", "size", "maybe", "rank", "print", "node", "component_id", "key", "text_sha256", "spans", "m", "s",
         "keys", "lines", "tokens", "block", "epoch", "id", "weight", "gone", "score", "license")


@pytest.fixture
def clash():
    return CLASH

import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture
def docs(spark):
    """A documents table from texts, or from (id, text) pairs."""

    def build(rows):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], DOCS)

    return build


@pytest.fixture
def clashing(docs):
    """The same with further columns under names that the operators use themselves."""

    def build(rows):
        names = ("id", "key", "fingerprint", "ids", "decoded", "log_weight", "row", "label", "group", "lines", "gone", "content", "x", "first", "n")
        return docs(rows).withColumns({n: F.concat(F.lit(f"{n}-"), F.coalesce(F.col("text"), F.lit("-"))) for n in names})

    return build

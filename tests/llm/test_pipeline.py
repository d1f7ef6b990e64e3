"""The queries over the smallest tables, and the pipeline stage by stage."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from hourline.llm import decontaminate, line_dedup
from hourline.llm.html_text import main_text
from hourline.llm.queries import BPE_FILE, QUERIES
from tests.llm.test_near_copies import groups_of, near
from tests.llm.test_text_filters import leaks, without_recurring
from tools.check import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_html_query_matches_the_marked_article(spark):
    for r in QUERIES["op2_html"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html"), "page_id").collect():
        assert r.text == main_text(r.html) and r.n_chars == len(r.text) > 0


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    rows = lambda df: sorted(df.collect(), key=lambda r: r.doc_id)
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        made[name] = (docs, stage(spark, docs, FOLDER).cache())
        docs = made[name][1]
        if name != "BPE encoding and decoding":
            assert docs.columns == columns

    before, after = made["quality classifier"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    marks, toxic = {r.doc_id: r.quality for r in labels}, {r.doc_id for r in labels if r.toxic}
    kept = {r.doc_id for r in after.collect()}
    assert rows(after) == [r for r in rows(before) if r.doc_id in kept]
    good = [i for i, q in marks.items() if q and i not in toxic]
    assert sum(i in kept for i in good) >= 0.9 * len(good)
    assert not any(i in kept for i, q in marks.items() if not q)

    before, after = made["line dedup"]
    assert [(r.doc_id, r.text) for r in rows(after)] == without_recurring([(r.doc_id, r.text) for r in rows(before)])
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = made["SimHash near-dedup"]
    held = sorted((r.doc_id, r.text) for r in before.collect())
    groups = groups_of(len(held), near([t for _, t in held], 4, 4))
    first = {held[g][0] for g in groups}
    assert rows(after) == [r for r in rows(before) if r.doc_id in first]

    before, after = made["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    found = {i for i, _ in leaks([(r.doc_id, r.text) for r in before.collect()], items)}
    assert rows(after) == [r for r in rows(before) if r.doc_id not in found]

    before, after = made["BPE encoding and decoding"]
    library = Tokenizer.from_file(BPE_FILE)
    for r in before.join(after, "doc_id").collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()


def test_run_on_odd_tables(spark, monkeypatch, tmp_path):
    """Null ids and texts, repeated rows, further columns and an empty table go through all stages."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    first = docs.first()
    odd = spark.createDataFrame([(None, None, None, None, None), (None, first.text, "en", "s", 1), (first.doc_id, first.text, first.lang, first.source, first.n_chars), (900001, "", "en", "s", 0)], docs.schema)
    for name, table in (("odd", docs.unionByName(odd).withColumns({"id": F.lit("x"), "key": F.lit(1), "ids": F.lit("y")})), ("empty", docs.limit(0))):
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{FOLDER}/{other}.parquet").write.parquet(f"{tmp_path}/{name}/{other}.parquet")
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.count() > 0 if name == "odd" else out.count() == 0


def test_run_writes_every_stage(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 100 and out.filter(F.col("n_tokens") < 0).count() == 0


@pytest.mark.parametrize("sql,query", [(line_dedup.line_dedup_sql, "op5_line_dedup"), (decontaminate.leaks_sql, "op9_decontaminate")])
def test_sql_of_native_operators(spark, con, sql, query):
    assert compare(QUERIES[query](spark, FOLDER).toPandas(), con.execute(sql()).df()).startswith("ok")

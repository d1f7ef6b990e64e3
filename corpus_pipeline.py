"""A corpus pipeline: quality, line dedup, near-copies, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes it as Parquet and reads it
back as the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourline.llm import bpe, decontaminate, line_dedup, quality, simhash
from hourline.llm.frames import read_table, stored
from hourline.llm.queries import BPE_FILE

#: SQL can't tell the sampling noise, SimHash components or token ids; tests compare with brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sampler rejects go."""
    return quality.resample(docs, read_table(spark, sf_dir, "labels")).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but the first; n_chars follows."""
    done = line_dedup.drop_recurring(docs)
    return done.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-copy group stays, the one with the least id."""
    return simhash.keep_first(docs, shingle=4, radius=4)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of the ids and of what they decode to."""
    return bpe.digests(docs, BPE_FILE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_copy_stage),
    ("benchmark decontamination", leak_stage),
    ("BPE encoding and decoding", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs

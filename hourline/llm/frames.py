"""Small frame helpers of the operators: stored tables, row identity, batches with one more column."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourline.sources.files import remove_path, work_path


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared work folder and read back: computed once, lineage cut."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._work_path = path
    return kept


def drop_stored(df: DataFrame) -> None:
    """Delete the table behind a frame that ``stored`` gave, once nothing reads it any more."""
    remove_path(df.sparkSession, df._work_path)


@contextmanager
def wide_rows(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What runs inside passes whole texts to Python in Arrow batches of at most ``rows`` rows, so that a batch stays small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The texts of a string column as UTF-8 bytes, one at a time; null counts as empty. Memory of earlier
    batches goes back to the system first."""
    pa.default_memory_pool().release_unused()
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """``make()`` runs once a task and gives the function that turns each Arrow batch into another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield each(batch)

    return df.mapInArrow(run, schema)


def with_added(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    """The schema of ``df`` and new fields behind it."""
    return T.StructType([*df.schema.fields, *fields])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it while the frame has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def col(name: str) -> F.Column:
    """A column whose name may hold dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")

"""Files: typed CSV scans, ragged files, audits, sinks, fitted models, and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourline.functions.parse import parse_ts
from hourline.operators.reshape import SEGMENT_LABELS

PROFILE_FIELDS = ["Type", "Date", *SEGMENT_LABELS]
_work_paths: list[str] = []


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only in a session on this machine alone and without the setting is a temporary folder made; it
    goes when Python ends. Any other session without the setting is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="hourline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, for tables that outlive the plan they come from."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _work_paths.append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a work path, wherever the shared folder is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if path in _work_paths:
        _work_paths.remove(path)


def clear_work(spark: SparkSession) -> None:
    """Delete all work paths of this process. Frames that read them can't be evaluated any more."""
    for path in list(_work_paths):
        remove_path(spark, path)


def read_series(spark, path, schema, drop_index=False) -> DataFrame:
    """Header CSV with a declared schema; ``drop_index`` drops the first column (a row index).

    ``path`` may be a glob or a folder: all files are one distributed scan.
    """
    df = spark.read.csv(path, schema=schema, header=True)
    return df.drop(df.columns[0]) if drop_index else df


def read_positions(spark, path, positions: dict[int, str], n_fields: int) -> DataFrame:
    """Header CSV read by position: {5: 'date', ...} names the fields to keep, all as STRING."""
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(n_fields)])
    df = spark.read.csv(path, schema=schema, header=True, enforceSchema=True)
    return df.select(*[F.col(f"_{i}").alias(name) for i, name in positions.items()])


def read_ragged(spark, path, fields=tuple(PROFILE_FIELDS), text=("Type", "Date")) -> DataFrame:
    """CSV files of several widths under one schema: the first fields of every line, by position.

    Wider lines lose their surplus at the end, which an inferred schema would misalign.
    """
    schema = T.StructType(
        [T.StructField(f, T.StringType() if f in text else T.DoubleType()) for f in fields]
    )
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True, mode="PERMISSIVE")


def read_matrix(spark, path, ids) -> DataFrame:
    """A wide CSV file (or glob) whose header names its columns: ``ids`` are text, all others numbers.

    The driver reads one header line for the schema; the rows are one distributed scan.
    """
    header = spark.read.csv(path, header=True).columns
    kinds = [T.StructField(c, T.StringType() if c in ids else T.DoubleType()) for c in header]
    return spark.read.csv(path, schema=T.StructType(kinds), header=True, enforceSchema=True)


def audit_files(spark, path, sep=",") -> DataFrame:
    """(file, n_fields, lines): the widths found in each file."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.size(F.split("value", sep)).alias("n_fields")
    )
    return lines.groupBy("file", "n_fields").agg(F.count(F.lit(1)).alias("lines"))


def read_load(spark, path, schema, ts="hour_end", fmt="yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """A load table whose stamp column is text."""
    df = read_series(spark, path, schema)
    return df.withColumn(ts, parse_ts(F.col(ts), fmt)).withColumnRenamed(ts, "ts")


def write_csv(df, path) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_table(df, path, partition_by=()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def save_model(model: PipelineModel, path) -> None:
    model.write().overwrite().save(path)


def load_model(path) -> PipelineModel:
    return PipelineModel.load(path)


def profile_table(df) -> DataFrame:
    """(column, dtype, non_null, rows): one aggregation over all columns."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(c).alias("non_null"))
            for c, t in df.dtypes
        ]
    )
    return counts.select(F.inline(cells), F.col("_rows").alias("rows"))

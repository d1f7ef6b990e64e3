"""Series in blocks, and matrices in binary columns: what learners of many small models share.

The models of a block of series fit on the driver and in a broadcast; blocks go one after another, so that
neither grows with the number of series.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.sources.files import work_path


def column_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def binary_matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """A BINARY column of equal lengths as a matrix."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), width)


def to_binary(matrix: np.ndarray) -> pa.Array:
    matrix = np.ascontiguousarray(matrix)
    width = matrix.strides[0] if len(matrix) else 0
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix.tobytes())])


def places_in(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each id stands in the sorted ``ids``; -1 if it isn't there."""
    at = np.minimum(np.searchsorted(ids, wanted), max(0, len(ids) - 1))
    return np.where(ids[at] == wanted, at, -1) if len(ids) else np.full(len(wanted), -1)


def series_id(keys):
    """A series as one number; NULL unless all keys are there."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return F.when(whole, F.xxhash64(*[F.col(k) for k in keys]))


def blocks_of(df: DataFrame, n: int) -> list[DataFrame]:
    """The rows of each block by their ``_id``, written once if there are several."""
    if n == 1:
        return [df]
    path = work_path(df.sparkSession, "blocks")
    df.withColumn("_block", F.pmod("_id", F.lit(n))).write.partitionBy("_block").parquet(path)
    whole = df.sparkSession.read.parquet(path)
    return [whole.filter(F.col("_block") == b).select(*df.columns) for b in range(n)]

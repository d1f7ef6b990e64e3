"""The k nearest shapes under DTW, exactly, through an index of symbolic words.

A shape's piecewise means become symbols by quantile breakpoints, and shapes of one word share a leaf (after Shieh and
Keogh's iSAX). A leaf of over ``CAPACITY`` shapes is split by twice as many symbols, up to 2 ** ``BITS`` of them; what
still overflows is parted by a hash. Of each leaf its least and largest value at every position is kept. Between these and the band
around a query lies a lower bound of the DTW distance to all shapes of the leaf.

Queries meet the boxes of leaves, in blocks of ``BLOCK``, not the shapes. A query's nearest leaves that hold k shapes give a first
radius; then only leaves within the radius send it their shapes, only those whose own lower bound is within it are compared by DTW, and the k
nearest of them are the answer: no bound is above the distance it stands for, so none is lost, and no pairs are listed
but those that a bound can't rule out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourline.functions.dtw import dtw_batch
from hourline.sources.files import work_path

PIECES, BITS, CAPACITY, BLOCK = 4, 4, 64, 20_000


def piecewise_means(shape: Column, length: int, pieces: int = PIECES) -> Column:
    """ARRAY<DOUBLE>: the mean of each of ``pieces`` stretches."""
    cuts = [length * i // pieces for i in range(pieces + 1)]
    return F.array(*[F.aggregate(F.slice(shape, a + 1, b - a), F.lit(0.0), lambda t, v: t + v) / F.lit(float(b - a)) for a, b in zip(cuts[:-1], cuts[1:])])


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def with_leaves(shapes: DataFrame, length: int, capacity: int = CAPACITY) -> DataFrame:
    """The shapes (node, shape), stored, with the ``leaf`` that each is in."""
    means = shapes.withColumn("_means", piecewise_means(F.col("shape"), length))
    shares = [i / 2**BITS for i in range(1, 2**BITS)]
    marks = means.select(F.explode("_means").alias("m")).agg(F.percentile_approx("m", F.array(*[F.lit(s) for s in shares]), 10_000)).first()[0] or [0.0] * len(shares)

    def word(bits: int) -> Column:
        cuts = F.array(*[F.lit(float(marks[i])) for i in range(2 ** (BITS - bits) - 1, len(marks), 2 ** (BITS - bits))])
        symbols = F.transform("_means", lambda m: F.size(F.filter(cuts, lambda c: c < m)).cast("string"))
        return F.concat_ws(".", F.lit(str(bits)), symbols)

    rows = means.withColumn("leaf", word(1))
    for bits in range(2, BITS + 1):
        full = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > capacity)
        rows = rows.join(full, "leaf", "left").withColumn("leaf", F.when(F.col("_n").isNotNull(), word(bits)).otherwise(F.col("leaf"))).drop("_n")
    full = rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(capacity)).alias("_parts"))
    parted = rows.join(full, "leaf").withColumn("leaf", F.concat_ws("#", "leaf", F.pmod(F.xxhash64("node"), F.col("_parts"))))
    return _stored(parted.select("node", "shape", "leaf"), "leaves")


def leaf_boxes(rows: DataFrame) -> DataFrame:
    """(leaf, n, low, high): the number of a leaf's shapes, and its least and largest values by position."""
    cells = rows.select("leaf", F.posexplode("shape").alias("pos", "v")).groupBy("leaf", "pos").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "lo", "hi")))
    boxes = cells.groupBy("leaf").agg(F.max("n").alias("n"), ordered.alias("b"))
    return boxes.select("leaf", "n", F.transform("b", lambda c: c["lo"]).alias("low"), F.transform("b", lambda c: c["hi"]).alias("high"))


def band(queries: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of each row of ``queries`` within ``w`` steps of each position."""
    n = queries.shape[1]
    spans = [queries[:, max(0, j - w) : j + w + 1] for j in range(n)]
    return np.stack([s.min(axis=1) for s in spans], axis=1), np.stack([s.max(axis=1) for s in spans], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _leaves_of(queries: DataFrame, boxes: pa.Table, w: int, k: int, radius: bool) -> DataFrame:
    """(query, leaf, bound): the leaves within each query's ``radius``; or the nearest ones that hold k shapes and one more, the query itself perhaps."""
    shared = queries.sparkSession.sparkContext.broadcast((np.array(boxes["leaf"].to_pylist(), dtype=object), boxes["n"].to_numpy(), _matrix(boxes["low"].combine_chunks()), _matrix(boxes["high"].combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes, low, high = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            query, (least, most) = batch.column(0).to_numpy(), band(_matrix(batch.column(1)), w)
            limit = batch.column(2).to_numpy() if radius else None
            for i in range(len(query)):
                bound = np.sqrt((np.maximum(np.maximum(low - most[i], least[i] - high), 0) ** 2).sum(axis=1))
                if radius:
                    at = np.flatnonzero(bound <= limit[i])
                else:
                    order = np.argsort(bound, kind="stable")
                    at = order[: np.searchsorted(np.cumsum(sizes[order]), k + 1) + 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), query[i])), pa.array(names[at], pa.string()), pa.array(bound[at])], names=["query", "leaf", "bound"])

    columns = ["query", "shape", "radius"] if radius else ["query", "shape"]
    return queries.select(*columns).mapInArrow(run, "query BIGINT, leaf STRING, bound DOUBLE")


def _compared(pairs: DataFrame, w: int, limited: bool) -> DataFrame:
    """(query, node, dist) of pairs (query, node, a, b, radius): DTW of those whose lower bound is within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = _matrix(batch.column(2)), _matrix(batch.column(3))
            at = np.arange(len(a))
            if limited:
                least, most = band(a, w)
                bound = np.sqrt((np.maximum(np.maximum(b - most, least - b), 0) ** 2).sum(axis=1))
                at = np.flatnonzero(bound <= batch.column(4).to_numpy() * (1 + 1e-12))
            if len(at):
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(dtw_batch(a[at], b[at], w))], names=["query", "node", "dist"])

    return pairs.select("query", "node", "a", "b", *(["radius"] if limited else [])).mapInArrow(run, "query BIGINT, node BIGINT, dist DOUBLE")


def nearest_shapes(shapes: DataFrame, asked: Column, k: int, w: int = 4, keys=("series", "year", "week"), capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """(keys, rank, neighbour's keys as ``near_<key>``, dist): the k nearest other shapes of each shape for which ``asked`` holds; ties go by the keys.

    All shapes have one length; those with a NULL are left out."""
    keys = list(keys)
    whole = shapes.filter(F.col("shape").isNotNull() & ~F.exists("shape", lambda v: v.isNull()))
    named = _stored(whole.select(*keys, "shape", asked.alias("_asked")).withColumn("node", F.monotonically_increasing_id()), "shapes")
    length = named.agg(F.max(F.size("shape"))).first()[0]
    empty = shapes.select(*keys, F.lit(1).alias("rank"), *[F.col(c).alias(f"near_{c}") for c in keys], F.lit(0.0).alias("dist")).limit(0)
    if length is None:
        return empty
    rows = with_leaves(named.select("node", "shape"), length, capacity)
    boxes = _stored(leaf_boxes(rows), "boxes")
    n_blocks = -(-boxes.count() // block)
    queries = named.filter("_asked").select(F.col("node").alias("query"), "shape")

    def pairs(met: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
        own = queries.select("query", F.col("shape").alias("a"))
        return met.select("query", "leaf", *extra).join(rows.select("leaf", "node", F.col("shape").alias("b")), "leaf").filter("query != node").join(own, "query")

    def blocks(of: DataFrame, radius: bool) -> DataFrame:
        out = None
        for b in range(n_blocks):
            part = boxes.filter(F.pmod(F.xxhash64("leaf"), F.lit(n_blocks)) == b).orderBy("leaf").toArrow()
            if part.num_rows:
                met = _leaves_of(of, part, w, k, radius)
                out = met if out is None else out.unionByName(met)
        return out

    first = _compared(pairs(blocks(queries, False)), w, False)
    order = W.partitionBy("query").orderBy("dist", "node")
    kth = first.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).groupBy("query").agg(F.max("dist").alias("d"), F.count(F.lit(1)).alias("n"))
    radius = F.when(F.col("n") == k, F.col("d")).otherwise(F.lit(float("inf")))
    limited = _stored(queries.join(kth, "query", "left").select("query", "shape", F.coalesce(radius, F.lit(float("inf"))).alias("radius")), "radii")
    near = _compared(pairs(blocks(limited, True)).join(limited.select("query", "radius"), "query"), w, True)
    ends = named.select(F.col("node"), *[F.col(c).alias(f"near_{c}") for c in keys])
    told = near.join(ends, "node").withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("dist", *[f"near_{c}" for c in keys]))).filter(F.col("rank") <= k)
    asked_by = named.select(F.col("node").alias("query"), *keys)
    return told.join(asked_by, "query").select(*keys, "rank", *[f"near_{c}" for c in keys], "dist")

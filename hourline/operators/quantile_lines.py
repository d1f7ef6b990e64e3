"""Linear quantile forecasts for many series and quantiles at once.

The pinball loss is minimised by reweighted least squares (Hunter and Lange, 2000): each step weighs the rows by
their last residuals, adds up cross products for all quantiles, and solves one small system per series and
quantile where the sums meet. A step is one pass over the cached rows; it sends the coefficients of a block of series to the tasks and brings
the next ones back, at most ``MAX_COEFS`` numbers. The weights are bounded by a margin that shrinks with the steps, down to ``FLAT`` of
the residual spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourline.operators.segments import attach_series, segment_of
from hourline.operators.series_blocks import binary_matrix, blocks_of, places_in, series_id, to_binary
from hourline.sources.files import remove_path, work_path

KEYS = ("series",)
#: The last margin, as a share of the residual spread, and the share that a step leaves of the one before.
FLAT, SHRINK = 1e-6, 0.8
#: Coefficients of one block of series.
MAX_COEFS = 4_000_000


def dot(x: str, coef: str) -> Column:
    return F.aggregate(F.zip_with(x, coef, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)


def _products(m: np.ndarray, y: np.ndarray, coef: np.ndarray, margin: float | None, quantiles: np.ndarray) -> np.ndarray:
    """For rows of one series: X'WX and X'Wy with the shift of each quantile, then the number of rows and the sum of y squared."""
    parts = []
    for q, b in zip(quantiles, coef, strict=True):
        weight = np.full(len(y), 0.5) if margin is None else 0.5 / (np.abs(y - m @ b) + margin)
        shift = 0.0 if margin is None else (q - 0.5) * m.sum(axis=0)
        parts += [(m.T @ (m * weight[:, None])).ravel(), m.T @ (weight * y) + shift]
    return np.concatenate([*parts, [len(y), y @ y]])


def _step(base: DataFrame, coef: np.ndarray, margin: np.ndarray | None, quantiles: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """(next coefficients, residual spread at the least squares start) of all series of a block."""
    n_series, n_quantiles, p = coef.shape
    width = n_quantiles * (p * p + p) + 2
    shared = base.sparkSession.sparkContext.broadcast((coef, margin))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coef, margin = shared.value
        for batch in batches:
            series, y = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            m = batch.column(1).flatten().to_numpy().reshape(-1, p)
            begins = np.flatnonzero(np.diff(series, prepend=-1))
            found = [_products(m[a:b], y[a:b], coef[series[a]], None if margin is None else margin[series[a]], quantiles) for a, b in zip(begins, [*begins[1:], len(y)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(series[begins], pa.int32()), to_binary(np.stack(found)) if found else pa.array([], pa.binary())], names=["series", "sums"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def solved(series: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
            out = np.zeros((len(series), n_quantiles * p + 1))
            for k, row in enumerate(total):
                for q in range(n_quantiles):
                    at = q * (p * p + p)
                    a, b = row[at : at + p * p].reshape(p, p), row[at + p * p : at + p * p + p]
                    out[k, q * p : q * p + p] = np.linalg.lstsq(a + ridge * np.eye(p), b, rcond=None)[0]
                n, square = row[-2:]
                first, b = row[: p * p].reshape(p, p) * 2, row[p * p : p * p + p] * 2  # plain sums at the start, where weights are a half
                x = out[k, :p]
                out[k, -1] = np.sqrt(max(square - 2 * x @ b + x @ first @ x, 0.0) / n)
            return pa.RecordBatch.from_arrays([pa.array(series, pa.int32()), to_binary(out)], names=["series", "coef"])

        for batch in batches:
            now = batch.column(0).to_numpy(), binary_matrix(batch.column(1), "f8", width)
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            first = np.flatnonzero(np.append(True, np.diff(now[0]) != 0)) if len(now[0]) else np.empty(0, np.int64)
            if len(first):
                added = now[0][first], np.add.reduceat(now[1], first)
                yield solved(*(x[:-1] for x in added))
                held = tuple(x[-1:] for x in added)
        if held is not None:
            yield solved(*held)

    partial = base.mapInArrow(sums, "series INT, sums BINARY")
    found = partial.repartition("series").sortWithinPartitions("series").mapInArrow(solve, "series INT, coef BINARY").toArrow().combine_chunks()
    shared.unpersist()
    numbers = binary_matrix(found["coef"].combine_chunks(), "f8", n_quantiles * p + 1)
    out, spread = np.zeros_like(coef), np.zeros(n_series)
    at = found["series"].to_numpy()
    out[at], spread[at] = numbers[:, :-1].reshape(-1, n_quantiles, p), numbers[:, -1]
    return out, spread


def fit_quantile_lines(rows, quantiles, steps=60, ridge=0.0, keys=KEYS, x="x", y="y") -> DataFrame:
    """(keys, q, coef): the coefficients of the columns in the array ``x`` for each quantile.

    Column 0 should be the constant 1. Rows with a NULL are left out, as are those without a key. Columns of very different sizes should be scaled
    first; ``ridge`` keeps systems of dependent columns solvable."""
    keys, spark, levels = list(keys), rows.sparkSession, np.array([float(q) for q in quantiles])
    whole = F.col(y).isNotNull() & F.col(x).isNotNull() & ~F.exists(x, lambda v: v.isNull())
    kept = rows.filter(whole).select(*keys, series_id(keys).alias("_id"), F.col(x).alias("x"), F.col(y).cast("double").alias("y")).filter("_id IS NOT NULL")
    sizes = kept.agg(F.approx_count_distinct("_id").alias("series"), F.max(F.size("x")).alias("p")).first()
    path = work_path(spark, "lines")
    kinds = {k: kept.schema[k].dataType for k in keys}
    empty = spark.createDataFrame([], ", ".join([*(f"`{k}` {t.simpleString()}" for k, t in kinds.items()), "q DOUBLE", "coef ARRAY<DOUBLE>"]))
    if not sizes["series"]:
        return empty
    p = sizes["p"]
    for part in blocks_of(kept, max(1, -(-sizes["series"] * len(levels) * p // MAX_COEFS))):
        names = part.select(*keys, "_id").distinct().orderBy("_id").toArrow()
        ids = names["_id"].to_numpy()
        shared = spark.sparkContext.broadcast(ids)

        def numbered(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(places_in(shared.value, batch.column(0).to_numpy()), pa.int32()), *batch.columns[1:]], names=["series", "x", "y"])

        stored = work_path(spark, "line-rows")
        part.select("_id", "x", "y").sortWithinPartitions("_id").mapInArrow(numbered, "series INT, x ARRAY<DOUBLE>, y DOUBLE").write.parquet(stored)
        base = spark.read.parquet(stored).persist()
        coef, spread = _step(base, np.zeros((len(ids), len(levels), p)), None, levels, ridge)
        for step in range(steps):
            coef, _ = _step(base, coef, spread * max(SHRINK**step, FLAT) + 1e-12, levels, ridge)
        base.unpersist()
        remove_path(spark, stored)
        each = np.repeat(np.arange(len(ids)), len(levels))
        table = {k: names[k].take(pa.array(each)) for k in keys} | {"q": pa.array(np.tile(levels, len(ids))), "coef": pa.array(list(coef.reshape(-1, p)), pa.list_(pa.float64()))}
        spark.createDataFrame(pa.table(table), empty.schema).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def predict_quantiles(rows, fit, names: dict[str, float], keys=KEYS, ts="ts", x="x") -> DataFrame:
    """The rows with a forecast column for each named quantile."""
    keys = list(keys)
    per_series = fit.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("q", "coef"))).alias("_coefs"))
    scored = attach_series(rows, per_series, keys, segment_of(ts))
    return scored.withColumns({n: F.aggregate(F.zip_with(x, F.element_at("_coefs", F.lit(float(q))), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v) for n, q in names.items()}).drop("_coefs")


def better_changes(rows, fit, share=0.01, keys=KEYS, ts="ts", x="x", y="y") -> DataFrame:
    """(keys, q, j, loss, lower, higher): the pinball loss, and what it becomes if coefficient j alone falls or rises by as much as moves the
    forecasts by ``share`` of the mean absolute residual on average."""
    keys = list(keys)
    per_series = fit.groupBy(*keys).agg(F.collect_list(F.struct("q", "coef")).alias("_fits"))
    whole = F.col(y).isNotNull() & F.col(x).isNotNull() & ~F.exists(x, lambda v: v.isNull())
    each = attach_series(rows.filter(whole), per_series, keys, segment_of(ts)).select(*keys, F.col(x).alias("x"), F.col(y).alias("y"), F.explode("_fits").alias("_f")).select(*keys, "x", "y", "_f.*")
    residual = each.withColumn("_r", F.col("y") - dot("x", "coef")).select(*keys, "q", "_r", F.posexplode("x").alias("j", "_x"))
    sizes = residual.groupBy(*keys, "q", "j").agg((F.lit(share) * F.try_divide(F.avg(F.abs("_r")), F.avg(F.abs("_x")))).alias("_h"))

    def loss(r):
        return F.avg(F.greatest(F.col("q") * r, (F.col("q") - 1) * r))

    moved = residual.join(sizes, [*keys, "q", "j"])
    shift = F.coalesce("_h", F.lit(0.0)) * F.col("_x")
    return moved.groupBy(*keys, "q", "j").agg(loss(F.col("_r")).alias("loss"), loss(F.col("_r") + shift).alias("lower"), loss(F.col("_r") - shift).alias("higher"))

"""Boosted and single regression trees for many series at once, grown level by level.

Every series has models of its own: one for each loss, which is squared error or the pinball loss of a
quantile. Feature values become bin numbers. A level of all trees of all series is one pass: tasks walk
their rows down the trees so far, add up gradients and counts by (node, feature, bin) in arrays, and the
arrays of a node meet to find its best split. So a round of depth d takes d passes, one more where
quantiles are fitted, whatever the number of series, losses and nodes; a series' rows are never gathered,
and the arrays of a node that meet are one for each task at most. A tree without a depth limit goes on
until no leaf can be split.

Series are fitted in blocks, by a hash of their keys, so that the trees of a block have at most ``MAX_NODES``
nodes: that is what the driver holds and broadcasts at a time. A fitted model is a table with one row for
each series; it is saved, loaded and filtered like any other.

Rows with split 'train' and a label fit the models, every row is scored. A NULL or NaN feature is less than any
number. A series without training rows, and a row without a key, have no forecast. Leaf quantiles come from mergeable
summaries: exact up to ``EXACT`` rows of a leaf, beyond that off by at most one rank in ``EXACT``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourline.operators.series_blocks import binary_matrix, blocks_of, column_of, places_in, series_id, to_binary
from hourline.sources.files import remove_path, work_path

KEYS = ("series",)
TRAIN = "split = 'train'"
#: Nodes of the trees of one block of series.
MAX_NODES = 2_000_000
EXACT = 20_000
#: Cells of the sums that a task holds at a time.
_CELLS = 1 << 22
#: Rounds after which the rows' state is written, which cuts its lineage.
_WRITE_EVERY = 20


@dataclass(frozen=True)
class Growth:
    """How trees grow. ``losses`` names the models: a quantile, or None for squared error. ``boosted`` models start from the training
    rows' mean or quantile and add ``rate`` times each tree; the others are one tree on the label itself."""

    losses: dict
    rounds: int = 100
    rate: float = 0.1
    max_depth: int | None = 3
    min_leaf: int = 10
    max_bins: int = 64
    boosted: bool = True

    def __post_init__(self) -> None:
        if not 2 <= self.max_bins <= 250 or self.min_leaf < 1 or (not self.boosted and self.rounds != 1):
            raise ValueError("2 to 250 bins, leaves of a row at least, and one round unless boosted")


class _Forest:
    """Trees of one round as flat arrays; tree t has its root at node t."""

    def __init__(self, n_trees: int) -> None:
        self.feature = np.full(n_trees, -1, np.int16)
        self.cut = np.zeros(n_trees, np.uint8)
        self.left, self.right = np.full(n_trees, -1, np.int32), np.full(n_trees, -1, np.int32)
        self.value, self.tree = np.zeros(n_trees), np.arange(n_trees)

    def walk(self, trees: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row in its tree."""
        node = trees.astype(np.int64)
        moving = np.flatnonzero(self.feature[node] >= 0)
        while len(moving):
            at = node[moving]
            beyond = bins[moving, self.feature[at]] > self.cut[at]
            node[moving] = np.where(beyond, self.right[at], self.left[at])
            moving = moving[self.feature[node[moving]] >= 0]
        return node

    def split(self, node: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """New children of the nodes: all left ones, then all right ones."""
        n, k = len(self.feature), len(node)
        self.feature[node], self.cut[node] = feature, cut
        self.left[node], self.right[node] = np.arange(n, n + k), np.arange(n + k, n + 2 * k)
        for name, new in (("feature", -1), ("cut", 0), ("left", -1), ("right", -1), ("value", 0)):
            old = getattr(self, name)
            setattr(self, name, np.append(old, np.full(2 * k, new, old.dtype)))
        self.tree = np.concatenate([self.tree, self.tree[node], self.tree[node]])
        return np.arange(n, n + 2 * k)


def _bin(values: list[np.ndarray], at: np.ndarray, edges: list[list[np.ndarray]]) -> np.ndarray:
    """Bin numbers of the features' values: 0 without a number, else 1 + the edges of the row's series that are smaller."""
    out = np.zeros((len(at), len(values)), np.uint8)
    order = np.argsort(at, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
        if len(run):
            for f, column in enumerate(values):
                x = column[run]
                out[run, f] = np.where(np.isnan(x), 0, 1 + np.searchsorted(edges[at[run[0]]][f], x))
    return out


def _numbers(features) -> list:
    return [F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)]


def _series_of(train: DataFrame, n_features: int, growth: Growth, keys) -> DataFrame:
    """(keys, _id, edges, start): for each series the cut values of each feature and what its models start from."""
    # values that are rarer than one in four times the bins may share a bin with a neighbour
    shares = [i / (4 * growth.max_bins) for i in range(4 * growth.max_bins + 1)]

    def edges(f: str):
        values = F.array_distinct(F.percentile_approx(f, F.array(*[F.lit(s) for s in shares]), 100 * growth.max_bins))
        inner = F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0)))  # none is beyond the largest
        step = F.ceil(F.size(inner) / F.lit(growth.max_bins - 1))
        return F.coalesce(F.filter(inner, lambda v, i: i % step == step - 1), F.array().cast("array<double>"))

    def start(loss):
        if not growth.boosted:
            return F.lit(0.0)
        return F.avg("_y") if loss is None else F.percentile_approx("_y", F.lit(loss), EXACT)

    return train.groupBy(*keys, "_id").agg(
        F.array(*[edges(f"_f{i}") for i in range(n_features)]).alias("edges"), F.array(*[start(x) for x in growth.losses.values()]).alias("start")
    )


class _Rows:
    """The training rows of a block: series, bins, label and a forecast of each model so far."""

    def __init__(self, frame: DataFrame, n_features: int, n_bins: int, growth: Growth) -> None:
        self.frame, self.path, self.age, self.stale = frame, None, 0, []
        self.n_features, self.n_bins, self.growth = n_features, n_bins, growth
        self.losses = list(growth.losses.values())
        self.names = [f"p{g}" for g in range(len(self.losses))]
        self.schema = ", ".join(["series INT", "bins BINARY", "y DOUBLE", *(f"{p} DOUBLE" for p in self.names)])
        self.spark = frame.sparkSession
        self.keep()

    def keep(self) -> None:
        """Cache the state, or write it, which cuts its lineage."""
        if self.age % _WRITE_EVERY == 0:
            path = work_path(self.spark, "boosting")
            self.frame.write.parquet(path)
            before, self.path = self.path, path
            self.frame = self.spark.read.schema(self.schema).parquet(path)
            if before:
                remove_path(self.spark, before)
        self.frame = self.frame.persist()
        self.age += 1

    def done(self) -> None:
        self.release()
        self.frame.unpersist()
        remove_path(self.spark, self.path)

    def best_splits(self, forest: _Forest, nodes: np.ndarray) -> dict[str, np.ndarray]:
        """For each of the nodes that has rows: its count and sum of gradients, and its best split (feature -1 if none)."""
        width, bins_at, n_models = self.n_features * self.n_bins, self.n_bins, len(self.losses)
        slot_of = np.full(len(forest.feature), -1, np.int64)
        slot_of[nodes] = np.arange(len(nodes))
        shared = self.spark.sparkContext.broadcast((forest, slot_of))
        gradient, n_features, min_leaf = self.gradient_function(), self.n_features, self.growth.min_leaf
        quantile = np.array([np.nan if x is None else x for x in self.losses])[forest.tree[nodes] % n_models]  # by slot

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, slots = shared.value
            held = None  # (slots, sums, counts) that may go on in the next batch

            def out(held) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(held[0], pa.int32()), to_binary(held[1]), to_binary(held[2])], names=["slot", "sums", "counts"])

            for batch in batches:
                if not batch.num_rows:
                    continue
                series, bins = column_of(batch, "series").astype(np.int64), binary_matrix(batch.column(1), "u1", n_features)
                for g in range(n_models):
                    slot = slots[trees.walk(series * n_models + g, bins)]
                    open_, weight = np.flatnonzero(slot >= 0), gradient(batch, g)
                    found, at = np.unique(slot[open_], return_inverse=True)
                    step = max(1, _CELLS // width)
                    for low in range(0, len(found), step):
                        part = np.flatnonzero((at >= low) & (at < low + step))
                        rows, k = open_[part], min(step, len(found) - low)
                        cell = (at[part] - low)[:, None] * width + np.arange(n_features) * bins_at + bins[rows]
                        total = np.bincount(cell.ravel(), np.repeat(weight[rows], n_features), k * width).reshape(k, width)
                        count = np.bincount(cell.ravel(), minlength=k * width).reshape(k, width)
                        now = found[low : low + k] * 1, total, count.astype(np.int64)
                        if held is not None and np.array_equal(held[0], now[0]):
                            held = now[0], held[1] + total, held[2] + now[2]
                        else:
                            if held is not None:
                                yield out(held)
                            held = now
            if held is not None:
                yield out(held)

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                now = column_of(batch, "slot"), binary_matrix(batch.column(1), "f8", width), binary_matrix(batch.column(2), "i8", width)
                if held is not None:
                    now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
                first = np.flatnonzero(np.append(True, np.diff(now[0]) != 0))
                added = now[0][first], np.add.reduceat(now[1], first), np.add.reduceat(now[2], first)
                yield _best(*(x[:-1] for x in added), n_features, bins_at, min_leaf, quantile)
                held = tuple(x[-1:] for x in added)
            if held is not None:
                yield _best(*held, n_features, bins_at, min_leaf, quantile)

        partial = self.frame.mapInArrow(sums, "slot INT, sums BINARY, counts BINARY")
        met = partial.repartition("slot").sortWithinPartitions("slot")
        found = met.mapInArrow(best, "slot INT, n BIGINT, s DOUBLE, feature INT, cut INT, n_left BIGINT, s_left DOUBLE").toArrow()
        shared.unpersist()
        return {name: found[name].to_numpy() for name in found.column_names}

    def gradient_function(self):
        """What is summed for a row: its residual, or for a quantile whether it isn't above the forecast. The latter's sums are whole
        numbers, so that they don't depend on the order of addition; ``_best`` makes gradients of them."""
        losses, names = self.losses, self.names

        def gradient(batch: pa.RecordBatch, g: int) -> np.ndarray:
            y, p = column_of(batch, "y"), column_of(batch, names[g])
            return y - p if losses[g] is None else (y <= p).astype(float)

        return gradient

    def leaf_quantiles(self, forest: _Forest) -> None:
        """The leaves of quantile models get the quantile of their rows' residuals."""
        asked = [g for g, loss in enumerate(self.losses) if loss is not None]
        if not asked:
            return
        shared, names, n_models, n_features = self.spark.sparkContext.broadcast(forest), self.names, len(self.losses), self.n_features

        def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                series, bins, y = column_of(batch, "series").astype(np.int64), binary_matrix(batch.column(1), "u1", n_features), column_of(batch, "y")
                for g in asked:
                    leaf = shared.value.walk(series * n_models + g, bins)
                    yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(y - column_of(batch, names[g]))], names=["leaf", "r"])

        shares = sorted({self.losses[g] for g in asked})
        residuals = self.frame.mapInArrow(leaves, "leaf INT, r DOUBLE")
        found = residuals.groupBy("leaf").agg(F.percentile_approx("r", F.array(*[F.lit(s) for s in shares]), EXACT).alias("q")).toArrow()
        leaf, q = found["leaf"].to_numpy(), found["q"].combine_chunks().flatten().to_numpy().reshape(-1, len(shares))
        which = np.array([shares.index(loss) if loss is not None else 0 for loss in self.losses])[forest.tree[leaf] % n_models]
        forest.value[leaf] = q[np.arange(len(leaf)), which]
        shared.unpersist()

    def add(self, forest: _Forest, rate: float) -> None:
        """Each row's forecasts move by its leaves' values."""
        shared, names, n_models, n_features = self.spark.sparkContext.broadcast(forest), self.names, len(self.losses), self.n_features

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                series, bins = column_of(batch, "series").astype(np.int64), binary_matrix(batch.column(1), "u1", n_features) if batch.num_rows else np.empty((0, n_features), np.uint8)
                moved = [pa.array(column_of(batch, p) + rate * shared.value.value[shared.value.walk(series * n_models + g, bins)]) for g, p in enumerate(names)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *moved], names=batch.schema.names)

        self.release()
        self.stale = [self.frame, shared]
        self.frame = self.frame.mapInArrow(move, self.schema)
        self.keep()

    def release(self) -> None:
        """Let go of what the present state was made from; the passes since have cached it."""
        for each in self.stale:
            each.unpersist()
        self.stale = []


def _best(slot, sums, counts, n_features: int, n_bins: int, min_leaf: int, quantile: np.ndarray) -> pa.RecordBatch:
    """The split with the largest fall of squared error, the first feature and lowest cut among equals."""
    m = len(slot)
    left, n_left = (x.reshape(m, n_features, n_bins).cumsum(axis=2) for x in (sums, counts))
    share = quantile[slot][:, None, None]
    left = np.where(np.isnan(share), left, share * n_left - left)
    whole, n = left[:, :1, -1:], n_left[:, :1, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        fall = left**2 / n_left + (whole - left) ** 2 / (n - n_left) - whole**2 / n
    fall = np.where((n_left >= min_leaf) & (n - n_left >= min_leaf), fall, -np.inf).reshape(m, n_features * n_bins)
    at = fall.argmax(axis=1) if m else np.empty(0, np.int64)
    rows = np.arange(m)
    good = fall[rows, at] > 1e-12 * np.abs(sums).reshape(m, n_features, n_bins)[:, 0].sum(axis=1) ** 2 / n[:, 0, 0]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(slot, pa.int32()), pa.array(n[:, 0, 0]), pa.array(whole[:, 0, 0]), pa.array(np.where(good, at // n_bins, -1), pa.int32()), pa.array(at % n_bins, pa.int32()),
            pa.array(n_left.reshape(m, n_features * n_bins)[rows, at]), pa.array(left.reshape(m, n_features * n_bins)[rows, at]),
        ],
        names=["slot", "n", "s", "feature", "cut", "n_left", "s_left"],
    )


def _grow(rows: _Rows, n_trees: int, growth: Growth) -> _Forest:
    """One round of trees: a level of all of them in a job."""
    forest, open_, depth = _Forest(n_trees), np.arange(n_trees), 0
    while len(open_) and (growth.max_depth is None or depth < growth.max_depth):
        found = rows.best_splits(forest, open_)
        node = open_[found["slot"]]
        if depth == 0:
            forest.value[node] = found["s"] / found["n"]
        good = found["feature"] >= 0
        n, s, n_left, s_left = (found[c][good] for c in ("n", "s", "n_left", "s_left"))
        children = forest.split(node[good], found["feature"][good], found["cut"][good])
        sizes, totals = np.append(n_left, n - n_left), np.append(s_left, s - s_left)
        forest.value[children] = totals / sizes
        open_ = children[sizes >= 2 * growth.min_leaf]
        depth += 1
    return forest


def _prepared(df: DataFrame, features, label: str | None, keys) -> DataFrame:
    columns = [series_id(keys).alias("_id"), *_numbers(features)]
    if label is not None:
        columns.append(F.when(F.expr(TRAIN) & ~F.isnan(F.col(label).cast("double")), F.col(label).cast("double")).alias("_y"))
    return df.select("*", *columns)


def fit_forest(df: DataFrame, features, growth: Growth, label="value", keys=KEYS) -> DataFrame:
    """The model table: (keys, edges, start, roots, feature, cut, left, right, value), a row for each series with training rows.

    ``roots`` has the first node of each tree in the arrays behind it, models within rounds."""
    features, keys, losses = list(features), list(keys), list(growth.losses.values())
    train = _prepared(df, features, label, keys).filter(F.col("_y").isNotNull() & F.col("_id").isNotNull()).select(*keys, "_id", *[f"_f{i}" for i in range(len(features))], "_y")
    spark = df.sparkSession
    sizes = train.agg(F.approx_count_distinct("_id").alias("series"), F.count(F.lit(1)).alias("rows")).first()
    leaves = 2**growth.max_depth if growth.max_depth is not None else max(1, sizes["rows"] // max(1, sizes["series"]) // growth.min_leaf)
    blocks = -(-2 * leaves * growth.rounds * len(losses) * sizes["series"] // MAX_NODES)
    path = work_path(spark, "forest")
    schema = None
    for part in blocks_of(train, max(1, blocks)):
        series = _series_of(part, len(features), growth, keys).orderBy("_id").toArrow()
        ids = series["_id"].to_numpy()
        if len(np.unique(ids)) != len(ids):
            raise ArithmeticError("two series share a hash: give one of them another key")
        edges = [[np.array(e) for e in row] for row in series["edges"].to_pylist()]
        start = np.array(series["start"].to_pylist(), dtype=float).reshape(len(ids), len(losses))
        shared = spark.sparkContext.broadcast((ids, edges, start))
        n_features = len(features)

        def to_bins(batches: Iterator[pa.RecordBatch], shared=shared, n_features=n_features) -> Iterator[pa.RecordBatch]:
            ids, edges, start = shared.value
            for batch in batches:
                at = places_in(ids, column_of(batch, "_id"))
                values = [column_of(batch, f"_f{i}").astype(float) for i in range(n_features)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int32()), to_binary(_bin(values, at, edges)), batch.column(batch.schema.get_field_index("_y")), *(pa.array(np.ascontiguousarray(p)) for p in start[at].T)],
                    names=["series", "bins", "y", *(f"p{g}" for g in range(start.shape[1]))],
                )

        state = ", ".join(["series INT", "bins BINARY", "y DOUBLE", *(f"p{g} DOUBLE" for g in range(len(losses)))])
        binned = part.sortWithinPartitions("_id").mapInArrow(to_bins, state)
        n_bins = 2 + max((len(e) for row in edges for e in row), default=0)
        rows = _Rows(binned, n_features, n_bins, growth)
        forests = []
        for done in range(growth.rounds if len(ids) else 0):
            forest = _grow(rows, len(ids) * len(losses), growth)
            rows.leaf_quantiles(forest)
            forests.append(forest)
            if done + 1 < growth.rounds:
                rows.add(forest, growth.rate)
        rows.done()
        table = _model_table(series, forests, len(losses), keys)
        schema = spark.createDataFrame(table).schema if schema is None else schema
        spark.createDataFrame(table, schema).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _model_table(series: pa.Table, forests: list[_Forest], n_models: int, keys) -> pa.Table:
    """A row for each series, with its trees of all rounds side by side."""
    columns: dict[str, list] = {c: [] for c in ("roots", "feature", "cut", "left", "right", "value")}
    members = [np.argsort(f.tree // n_models, kind="stable") for f in forests]
    bounds = [np.searchsorted((f.tree // n_models)[m], np.arange(series.num_rows + 1)) for f, m in zip(forests, members, strict=True)]
    for s in range(series.num_rows):
        parts: dict[str, list] = {c: [] for c in columns}
        size = 0
        for forest, member, bound in zip(forests, members, bounds, strict=True):
            own = member[bound[s] : bound[s + 1]]
            place = np.full(len(forest.feature) + 1, -1, np.int64)  # the last one stands for no child
            place[own] = size + np.arange(len(own))
            parts["roots"].append(place[np.arange(s * n_models, (s + 1) * n_models)])
            for c in ("left", "right"):
                parts[c].append(place[getattr(forest, c)[own]])
            for c in ("feature", "cut", "value"):
                parts[c].append(getattr(forest, c)[own])
            size += len(own)
        for c in columns:
            columns[c].append(np.concatenate(parts[c]).astype(float if c == "value" else np.int32) if parts[c] else np.empty(0))
    lists = {c: pa.array(v, pa.list_(pa.float64() if c == "value" else pa.int32())) for c, v in columns.items()}
    return pa.table({**{k: series[k] for k in [*keys, "edges", "start"]}, **lists})


def score_forest(model: DataFrame, df: DataFrame, features, growth: Growth, keys=KEYS) -> DataFrame:
    """``df`` with a forecast column for each model of ``growth.losses``; walks every row down its series' trees."""
    features, keys, names = list(features), list(keys), list(growth.losses)
    n_models, n_features, rate, boosted = len(names), len(features), growth.rate, growth.boosted
    known = model.withColumn("_id", series_id(keys))
    nodes = known.agg(F.sum(F.size("feature")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-nodes // MAX_NODES))
    rows = _prepared(df, features, None, keys)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    out = None
    models = [known] if n_blocks == 1 else [known.filter(F.pmod("_id", F.lit(n_blocks)) == b) for b in range(n_blocks)]
    for part, own in zip(blocks_of(rows, n_blocks), models, strict=True):
        table = own.orderBy("_id").toArrow()
        edges = [[np.array(e) for e in row] for row in table["edges"].to_pylist()]
        arrays = [{c: np.array(table[c][s].as_py()) for c in ("start", "roots", "feature", "cut", "left", "right", "value")} for s in range(table.num_rows)]
        shared = df.sparkSession.sparkContext.broadcast((table["_id"].to_numpy(), edges, arrays))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, edges, arrays = shared.value
            for batch in batches:
                wanted = batch.column(batch.schema.get_field_index("_id"))
                at = places_in(ids, wanted.fill_null(0).to_numpy())
                at[wanted.is_null().to_numpy(zero_copy_only=False)] = -1
                here = np.flatnonzero(at >= 0)
                values = [column_of(batch, f"_f{i}").astype(float)[here] for i in range(n_features)]
                bins = _bin(values, at[here], edges)
                preds = np.full((n_models, batch.num_rows), np.nan)
                for s in np.unique(at[here]):
                    own, mine = np.flatnonzero(at[here] == s), arrays[s]
                    forest = _Forest(0)
                    forest.feature, forest.cut, forest.left, forest.right = mine["feature"], mine["cut"], mine["left"], mine["right"]
                    total = np.repeat(mine["start"][:, None], len(own), axis=1)
                    for r in range(0, len(mine["roots"]), n_models):
                        for g in range(n_models):
                            leaf = forest.walk(np.full(len(own), mine["roots"][r + g]), bins[own])
                            total[g] += (rate if boosted else 1.0) * mine["value"][leaf]
                    preds[:, here[own]] = total
                kept = batch.columns[: batch.num_columns - 1 - n_features]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(p, from_pandas=True) for p in preds)], names=schema.names)

        scored = part.mapInArrow(score, schema)
        out = scored if out is None else out.unionByName(scored)
    return out


def _fit_and_score(df, features, growth: Growth, label, keys) -> DataFrame:
    return score_forest(fit_forest(df, features, growth, label, keys), df, features, growth, keys)


def tree_by_series(df, features, label="value", keys=KEYS, min_leaf=20, max_bins=250) -> DataFrame:
    """Adds ``pred``: one tree for each series, grown until no leaf can be split into two of ``min_leaf`` rows."""
    return _fit_and_score(df, features, Growth({"pred": None}, 1, 1.0, None, min_leaf, max_bins, boosted=False), label, keys)


def gbt_by_series(df, features, label="value", keys=KEYS, **params) -> DataFrame:
    """Adds ``pred``: boosted trees with squared loss for each series."""
    return _fit_and_score(df, features, Growth({"pred": None}, **params), label, keys)


def band_by_series(df, features, alpha=0.99, label="value", keys=KEYS, **params) -> DataFrame:
    """Adds ``lower``, ``mid`` and ``upper``: boosted quantiles 1 - alpha and alpha around the squared-loss forecast, for each series."""
    return _fit_and_score(df, features, Growth({"lower": 1.0 - alpha, "mid": None, "upper": alpha}, **params), label, keys)

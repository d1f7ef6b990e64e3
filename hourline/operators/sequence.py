"""A sequence model trained by gradient descent in Spark: a stack of dilated causal convolutions.

Layer l sees a step and the one 2^l steps before it, so ``layers`` of them look back 2^layers - 1 steps; a
hidden layer with a rectifier and one output follow. The model is trained with teacher forcing: its input is the
encode block and the decode block without its last step, and each of the last steps of the output forecasts the
next value. Forecasts go the other way: a predicted step is appended to the history, and the next one follows.

One model serves all series, as they are centred. A training step is one job: the weights are broadcast, tasks turn
Arrow batches of sequences into sums of gradients, one for each task, those are added up in a tree of ``FAN``
parts, and one vector of the weights' size comes back for the optimiser's step. So what a step moves doesn't
depend on the number of sequences. Batches are dealt by a hash of (epoch, sequence), so that every sequence takes part
once an epoch and a rerun gives the same model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.operators.recursive import last_values
from hourline.operators.segments import HALO, RN, chunk_window, index_rows, with_chunks

KEYS = ("series",)
FAN = 8


@dataclass(frozen=True)
class Network:
    """Sizes of the model, and how it is trained. Losses are the mean absolute error, or the pinball loss of ``quantile``."""

    layers: int = 8
    filters: int = 32
    hidden: int = 128
    quantile: float = 0.5
    epochs: int = 10
    batches: int = 4
    rate: float = 0.001
    seed: int = 0

    @property
    def reach(self) -> int:
        """Steps that an output depends on."""
        return 2**self.layers

    def shapes(self) -> list[tuple[str, tuple[int, ...]]]:
        out, width = [], 1
        for layer in range(self.layers):
            out += [(f"now{layer}", (width, self.filters)), (f"past{layer}", (width, self.filters)), (f"bias{layer}", (self.filters,))]
            width = self.filters
        return [*out, ("hidden", (width, self.hidden)), ("hidden_bias", (self.hidden,)), ("out", (self.hidden, 1)), ("out_bias", (1,))]

    def start(self) -> np.ndarray:
        """Weights drawn from the range that keeps the layers' spread."""
        rng, parts = np.random.default_rng(self.seed), []
        for name, shape in self.shapes():
            fan = sum(shape) * (2 if name.startswith(("now", "past")) else 1)
            parts.append(rng.uniform(-1, 1, shape).ravel() * np.sqrt(6 / fan) if len(shape) == 2 else np.zeros(shape))
        return np.concatenate(parts)

    def named(self, weights: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes():
            size = int(np.prod(shape))
            out[name] = weights[at : at + size].reshape(shape)
            at += size
        return out


def _earlier(x: np.ndarray, steps: int) -> np.ndarray:
    """The values ``steps`` before, zero where there are none."""
    out = np.zeros_like(x)
    out[:, steps:] = x[:, :-steps] if steps < x.shape[1] else 0
    return out


def _later(x: np.ndarray, steps: int) -> np.ndarray:
    out = np.zeros_like(x)
    if steps < x.shape[1]:
        out[:, :-steps] = x[:, steps:]
    return out


def outputs(net: Network, weights: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
    """(sequence, step) outputs for the sequences in the rows of ``x``, and what the layers saw."""
    w, h, seen = net.named(weights), x[:, :, None], []
    for layer in range(net.layers):
        past = _earlier(h, 2**layer)
        seen.append((h, past))
        h = h @ w[f"now{layer}"] + past @ w[f"past{layer}"] + w[f"bias{layer}"]
    inner = h @ w["hidden"] + w["hidden_bias"]
    seen.append((h, inner))
    return (np.maximum(inner, 0) @ w["out"] + w["out_bias"])[:, :, 0], seen


def loss_and_gradient(net: Network, weights: np.ndarray, x: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of the loss over sequences and steps of ``target``, which the last outputs forecast, and its gradient."""
    y, seen = outputs(net, weights, x)
    n = target.shape[1]
    error = target - y[:, -n:]
    loss = np.maximum(net.quantile * error, (net.quantile - 1) * error).sum()
    dy = np.zeros_like(y)
    dy[:, -n:] = np.where(error > 0, -net.quantile, np.where(error < 0, 1 - net.quantile, 0.0))
    w, grad = net.named(weights), {}
    h, inner = seen[-1]
    dy = dy[:, :, None]
    grad["out"], grad["out_bias"] = np.einsum("nti,nto->io", np.maximum(inner, 0), dy), dy.sum((0, 1))
    d_inner = (dy @ w["out"].T) * (inner > 0)
    grad["hidden"], grad["hidden_bias"] = np.einsum("nti,nto->io", h, d_inner), d_inner.sum((0, 1))
    dh = d_inner @ w["hidden"].T
    for layer in reversed(range(net.layers)):
        before, past = seen[layer]
        grad[f"now{layer}"], grad[f"past{layer}"], grad[f"bias{layer}"] = np.einsum("nti,nto->io", before, dh), np.einsum("nti,nto->io", past, dh), dh.sum((0, 1))
        dh = dh @ w[f"now{layer}"].T + _later(dh @ w[f"past{layer}"].T, 2**layer)
    return float(loss), np.concatenate([grad[name].ravel() for name, _ in net.shapes()])


def training_sequences(df, encode: int, decode: int, hop: int, keys=KEYS, ts="ts", value="value") -> DataFrame:
    """(keys, first, mean, spread, x, y): every ``hop`` rows a sequence of ``encode`` and ``decode`` consecutive values, less the encode
    block's mean, in units of its spread. ``x`` is forced: all but the last value; ``y`` has the decode block. Sequences with a NULL are left out."""
    size = encode + decode
    chunks = with_chunks(index_rows(df, keys, ts), 0, size)
    framed = chunks.withColumn("_all", F.collect_list(value).over(chunk_window(keys).rowsBetween(0, size - 1)))
    whole = framed.filter(~F.col(HALO) & (F.col(RN) % hop == 0) & (F.size("_all") == size))
    return _centred(whole.select(*keys, F.col(RN).alias("first"), "_all"), encode).select(
        *keys, "first", "mean", "spread", F.slice("_all", 1, size - 1).alias("x"), F.slice("_all", encode + 1, decode).alias("y")
    )


def _centred(rows, encode: int) -> DataFrame:
    """``_all`` less the mean of its first ``encode`` values, over their standard deviation (1 if they are constant)."""
    block = F.slice("_all", 1, encode)
    mean = F.aggregate(block, F.lit(0.0), lambda t, v: t + v) / encode
    spread = F.sqrt(F.aggregate(block, F.lit(0.0), lambda t, v: t + (v - F.col("mean")) * (v - F.col("mean"))) / encode)
    scaled = rows.withColumn("mean", mean).withColumn("spread", spread).withColumn("spread", F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0))
    return scaled.withColumn("_all", F.transform("_all", lambda v: (v - F.col("mean")) / F.col("spread")))


def sequence_forecast(df, encode: int, decode: int, horizon: int, hop: int, net: Network, keys=KEYS, ts="ts", value="value") -> DataFrame:
    """(keys, step, pred): the model is trained on the sequences of all series and goes on from each series' last ``encode`` values."""
    weights, _ = fit(training_sequences(df, encode, decode, hop, keys, ts, value), net, (*keys, "first"))
    last = last_values(df, encode, keys, ts, value).filter((F.size("tail") == encode) & ~F.exists("tail", lambda v: v.isNull()))
    scaled = _centred(last.withColumnRenamed("tail", "_all"), encode).select(*keys, "mean", "spread", F.col("_all").alias("x"))
    ahead = decode_steps(scaled, net, weights, horizon, keys)
    return ahead.join(scaled.select(*keys, "mean", "spread"), list(keys)).select(*keys, "step", (F.col("mean") + F.col("spread") * F.col("pred")).alias("pred"))


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The batch's (input, target) matrices, by their lengths; at most 64 sequences at once."""
    rows: dict[tuple[int, int], list] = {}
    for x, y in zip(batch.column(0), batch.column(1), strict=True):
        x, y = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
        rows.setdefault((len(x), len(y)), []).append((x, y))
    for same in rows.values():
        for k in range(0, len(same), 64):
            yield np.stack([x for x, _ in same[k : k + 64]]), np.stack([y for _, y in same[k : k + 64]])


def gradient(net: Network, weights: np.ndarray, sequences: DataFrame) -> tuple[float, np.ndarray, int]:
    """Sums over sequences (x ARRAY, y ARRAY): loss, gradient and number of forecast steps."""
    shared = sequences.sparkSession.sparkContext.broadcast(weights)

    def out(sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 + len(shared.value))
        for batch in batches:
            for x, y in _groups(batch):
                loss, slope = loss_and_gradient(net, shared.value, x, y)
                sums += np.concatenate([[loss, y.size], slope])
        yield out(sums)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 + len(shared.value))
        for batch in batches:
            for value in batch.column(0):
                sums += np.frombuffer(value.as_py())
        yield out(sums)

    parts = sequences.select("x", "y").mapInArrow(partial, "sums BINARY").repartition(FAN).mapInArrow(add_up, "sums BINARY")
    sums = np.sum([np.frombuffer(r.sums) for r in parts.collect()], axis=0)  # FAN vectors
    shared.unpersist()
    return float(sums[0]), sums[2:], int(sums[1])


def fit(sequences: DataFrame, net: Network, by: tuple[str, ...] = KEYS) -> tuple[np.ndarray, list[float]]:
    """(weights, mean loss of each epoch) from sequences (x, y and the columns ``by``, which name a sequence), by Adam."""
    cached = sequences.select(*by, "x", "y").persist()
    weights, losses, step = net.start(), [], 0
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    try:
        for epoch in range(net.epochs):
            total = count = 0
            for b in range(net.batches):
                own = cached.filter(F.pmod(F.xxhash64(F.lit(epoch), *by), F.lit(net.batches)) == b) if net.batches > 1 else cached
                loss, slope, n = gradient(net, weights, own)
                if n:
                    step += 1
                    slope = slope / n
                    mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
                    weights = weights - net.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
                total, count = total + loss, count + n
            losses.append(total / max(1, count))
    finally:
        cached.unpersist()
    return weights, losses


def decode_steps(histories: DataFrame, net: Network, weights: np.ndarray, horizon: int, keys=KEYS) -> DataFrame:
    """(keys, step, pred): step by step forecasts from histories (keys, x), each with its last steps; a short one counts as preceded by zeros."""
    shared = histories.sparkSession.sparkContext.broadcast(weights)
    schema = ", ".join([*(f"`{k}` {histories.schema[k].dataType.simpleString()}" for k in keys), "pred ARRAY<DOUBLE>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.zeros((batch.num_rows, net.reach + horizon))
            for i, value in enumerate(batch.column(batch.num_columns - 1)):
                tail = value.values.to_numpy(zero_copy_only=False)[-net.reach :]
                x[i, net.reach - len(tail) : net.reach] = tail
            for step in range(horizon):
                x[:, net.reach + step] = outputs(net, shared.value, x[:, step : net.reach + step])[0][:, -1]
            pred = pa.array(list(x[:, net.reach :]), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pred], names=[*keys, "pred"])

    made = histories.select(*keys, "x").mapInArrow(run, schema)
    return made.select(*keys, F.posexplode("pred").alias("_i", "pred")).select(*keys, (F.col("_i") + 1).alias("step"), "pred")

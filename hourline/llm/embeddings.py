"""Embedding near-copies by Euclidean p-stable hashing.

A unit vector's projection on a Gaussian direction, shifted and cut into cells of one width, keeps
near vectors in one cell (Datar et al., "Locality-sensitive hashing scheme based on p-stable
distributions", 2004). ``N_HASHES`` cells make the bucket of a table; vectors that share a bucket in
any of ``N_TABLES`` tables are compared by their exact cosine in double precision, so that nothing
below the threshold is linked. At cosine 0.98 a pair shares a cell with probability 0.933 and a bucket
of some table with probability over 0.9995; nearer pairs are found more often.

Equal vectors of a label are one node with a weight, so groups of exact copies are never compared
pair by pair. A bucket of over ``BLOCK`` nodes is cut into blocks, and each pair of blocks is a group
of its own, so no task holds a hot bucket whole. Of a group leave one row of link counts for each node
and a spanning forest: no pairs. A pair that several tables find is counted in the first of them,
which both nodes' bucket numbers tell.

Defined results: vectors that are null, empty or zero, or that hold nulls or non-finite components,
and vectors without a label, link with nothing. So do vectors of different length. Repeated rows are
vectors of their own; a null id is left out of "smallest id", and a group of null ids has a null
component. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.llm.components import connected_components
from hourline.llm.frames import col, stored

THRESHOLD = 0.98
N_TABLES, N_HASHES, WIDTH, SEED = 28, 20, 2.4, 11
#: Nodes of a group that are compared at once.
BLOCK = 2048


def _nodes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v): v is the vector as an array of doubles, null if it links with nothing."""
    v = col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = col(label_col).isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    return vectors.select(col(id_col).alias("id"), col(label_col).alias("label"), F.when(good, F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))


def _hashes(units: np.ndarray) -> np.ndarray:
    """Bucket numbers of unit vectors, one column for each table."""
    rng = np.random.default_rng(SEED)
    planes, shifts = rng.normal(size=(units.shape[1], N_TABLES * N_HASHES)), rng.uniform(0, WIDTH, N_TABLES * N_HASHES)
    cells = np.floor((units @ planes + shifts) / WIDTH).astype(np.int64).reshape(len(units), N_TABLES, N_HASHES)
    odd = rng.integers(1, 1 << 62, N_HASHES, dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        mixed = (cells * odd).sum(axis=2)
    return ((mixed ^ (mixed >> 29)) & 0x7FFFFFFF).astype(np.int32)


def _units(values: list[bytes]) -> np.ndarray:
    v = np.array([np.frombuffer(x, "<f8") for x in values])
    v = v / np.abs(v).max(axis=1, keepdims=True)  # the squares of huge or tiny components stay finite
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _with_buckets(nodes: DataFrame) -> DataFrame:
    """(node, label, dim, v as bytes, buckets as bytes) of each node (node, label, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(2).offsets.to_numpy()
            flat = batch.column(2).values.to_numpy(zero_copy_only=False)
            values = [flat[a:b].astype("<f8").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            dims = np.diff(ends)
            buckets = np.empty((len(values), N_TABLES), dtype="<i4")
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                buckets[at] = _hashes(_units([values[i] for i in at]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims.astype(np.int32)), pa.array(values, pa.binary()), pa.array([b.tobytes() for b in buckets], pa.binary())], names=["node", "label", "dim", "v", "buckets"])

    label = nodes.schema["label"].dataType.simpleString()
    return nodes.select("node", "label", "v").mapInArrow(run, f"node BIGINT, label {label}, dim INT, v BINARY, buckets BINARY")


def _grouped(nodes: DataFrame, block: int) -> DataFrame:
    """(group, side, node, weight, v, buckets, table): the nodes of each bucket, or pair of blocks of one.

    Buckets of one node are left out; ``side`` is 0 for the first block of a pair and 1 for the other.
    """
    slim = nodes.select("node", "label", "dim", "buckets")
    parts = [F.conv(F.hex(F.substring("buckets", 4 * t + 1, 4)), 16, 10).cast("bigint") for t in range(N_TABLES)]
    dealt = slim.select("node", "label", "dim", F.posexplode(F.array(*parts)).alias("table", "bucket"))
    bucket = ["label", "dim", "table", "bucket"]
    sizes = dealt.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    n = F.ceil(F.col("size") / F.lit(block)).cast("int")
    sized = dealt.join(sizes, bucket).withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    others = F.sequence(F.lit(0), F.col("n") - 1)
    dealt = sized.select("node", *bucket, "own", F.explode(others).alias("other"))
    group = F.xxhash64(*bucket, F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") > F.col("other"), 1).otherwise(0)
    keys = dealt.select("node", group.alias("group"), side.alias("side"), (F.col("own") == F.col("other")).alias("within"), "table")
    return keys.join(nodes.select("node", "weight", "v", "buckets"), "node")


def _compared(grouped: DataFrame, threshold: float) -> DataFrame:
    """(node, n, least): for each node of a group the weight it links to and a forest's edge."""
    columns = ["group", "side", "within", "table", "node", "weight", "v", "buckets"]
    rows = grouped.select(*columns).repartition("group").sortWithinPartitions("group", "side", "node")

    def compare(held: list[tuple]) -> pa.RecordBatch | None:
        sides = np.array([r[1] for r in held])
        table = held[0][3]
        node, weight = np.array([r[4] for r in held]), np.array([r[5] for r in held])
        units = _units([r[6] for r in held])
        buckets = np.array([np.frombuffer(r[7], "<i4") for r in held])
        within = held[0][2]
        ones = np.arange(len(held)) if within else np.flatnonzero(sides == 0)
        twos = ones if within else np.flatnonzero(sides == 1)
        count, parent = np.zeros(len(held), np.int64), np.arange(len(held))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for k in range(0, len(ones), 256):
            some = ones[k : k + 256]
            near = units[some] @ units[twos].T >= threshold
            if within:
                near &= some[:, None] != twos[None, :]
            for t in range(table):  # counted there already
                near &= buckets[some, t][:, None] != buckets[twos, t][None, :]
            count[some] += near @ weight[twos]
            if not within:
                count[twos] += near.T @ weight[some]
            a, b = np.nonzero(near)
            a, b = some[a], twos[b]
            while len(a):
                apart = parent[a] != parent[b]
                a, b = a[apart], b[apart]
                first = np.flatnonzero(np.diff(a, prepend=-1))
                for x, y in zip(a[first].tolist(), b[first].tolist(), strict=True):  # then the rest is looked at again
                    x, y = root(x), root(y)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                parent[:] = [root(i) for i in range(len(parent))]
        told = np.flatnonzero(count > 0)
        if not len(told):
            return None
        return pa.RecordBatch.from_arrays([pa.array(node[told]), pa.array(count[told]), pa.array(node[parent[told]])], names=["node", "n", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0]:
                    if len(held) > 1 and (found := compare(held)) is not None:
                        yield found
                    held = []
                held.append(row)
        if len(held) > 1 and (found := compare(held)) is not None:
            yield found

    return rows.mapInArrow(run, "node BIGINT, n BIGINT, least BIGINT")


def near_copies(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``vectors``."""
    rows = _nodes(vectors, id_col, vector_col, label_col)
    classes = rows.filter(F.col("v").isNotNull()).groupBy("label", "v").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("least_id"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "*"), "vectors")
    nodes = stored(_with_buckets(classes).join(classes.select("node", "weight"), "node"), "buckets")
    found = stored(_compared(_grouped(nodes, block), threshold), "links")
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = classes.join(groups, "node", "left").select("node", "label", "v", "weight", "least_id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "component").join(counts, "node", "left")
    named = named.select("label", "v", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    linked = rows.filter(F.col("v").isNotNull()).join(named, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.filter(F.col("v").isNull()).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))

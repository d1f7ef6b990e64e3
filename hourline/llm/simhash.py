"""SimHash near-copies with BK-trees.

Every text gets a 64-bit SimHash of its word shingles. Fingerprints are compared inside shards only: a
BK-tree in each shard follows the edges within the radius. The trees are built where their shard's rows
are. They are not broadcast: all trees together grow with the corpus, so that no size bound could be
given for them.

``near_copies`` links fingerprints that differ in at most ``radius`` bits, all of them: such two differ
in at most ``radius`` of ``radius + 2`` bit blocks and so agree on two, and each pair of blocks makes a
shard. Equal fingerprints are one node, so a group of exact copies costs one row whatever its size. A shard of over
``CROWD`` nodes is cut into blocks, by a hash, and each two blocks meet in a task of their own, so that no task holds more
than two blocks. Of each task only a spanning forest leaves, never all pairs, and the forests' components are those of
all links.

Defined results: a null text counts as empty; a text without words has fingerprint zero, which links
like any other; a text with fewer words than a shingle counts as one shingle. Repeated rows give
repeated rows. The component of a group is its smallest id; ids that are null don't count, and a group
of null ids has a null component. ``keep_first`` keeps one row for each group, the first by id, then
by its whole content, nulls last.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from hourline.llm.bit_filter import BitFilter
from hourline.llm.bktree import links
from hourline.llm.components import connected_components
from hourline.llm.frames import col, stored, utf8

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Nodes of a shard that are compared in one task.
CROWD = 1 << 14
#: Shingles whose bits are counted at once.
_STEP = 1 << 14


def shingle_hashes(text: bytes, shingle: int, seeds: tuple[int, ...] = (SEED,)) -> Iterator[np.ndarray]:
    """XXH64, one row for each seed, of each word shingle of a UTF-8 text, repeats included, some thousands at a time. Words are
    parted by ASCII white space, A-Z count as a-z; fewer words than a shingle count as one."""
    words = text.lower().split()  # bytes: ASCII only
    if not words:
        return
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    for k in range(0, n, _STEP):
        parts = [joined[a:b] for a, b in zip(starts[k : min(k + _STEP, n)], stops[k : k + _STEP], strict=False)]
        yield np.array([[xxh64_intdigest(part, seed) for part in parts] for seed in seeds], dtype="<u8")


def fingerprint(text: bytes, shingle: int, seeds: tuple[int, ...] = (SEED,)) -> list[int]:
    """The SimHash of a UTF-8 text, a word for each seed: bit k is 1 if it is set in over half of the
    shingles' hashes."""
    counts, n = np.zeros((len(seeds), 64), np.int64), 0
    for hashes in shingle_hashes(text, shingle, seeds):
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(len(seeds), -1, 64)
        counts += bits.sum(axis=1, dtype=np.int64)
        n += hashes.shape[1]
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """(id, fingerprint BIGINT, and for further seeds fingerprint_1 ...) of each row."""
    names = [f"fingerprint_{i}" if i else "fingerprint" for i in range(len(seeds))]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle, seeds) for t in utf8(batch.column(1))], dtype=np.uint64).reshape(-1, len(seeds))
            words = [pa.array(np.ascontiguousarray(w).view(np.int64)) for w in prints.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *words], names=schema.names)

    return docs.select(col(id_col), col(text_col).cast("string")).mapInArrow(run, schema)


def _shards(prints: DataFrame, radius: int) -> DataFrame:
    """(shard, fingerprint): one row for each pair of the radius + 2 bit blocks."""
    bounds = [64 * i // (radius + 2) for i in range(radius + 3)]

    def block(i: int) -> F.Column:
        mask = (1 << (bounds[i + 1] - bounds[i])) - 1
        return F.shiftrightunsigned("fingerprint", bounds[i]).bitwiseAND(F.lit(mask).cast("bigint"))

    pairs = [F.struct(F.lit(n).alias("pair"), block(i).alias("x"), block(j).alias("y")) for n, (i, j) in enumerate(combinations(range(radius + 2), 2))]
    return prints.select("fingerprint", F.explode(F.array(*pairs)).alias("s")).select("s.*", "fingerprint")


def _block_pairs(shards: DataFrame, crowd: int) -> DataFrame:
    """(pair, x, y, low, high, fingerprint): small shards as they are, with blocks 0 and 0; of larger ones each node goes to its block's meetings with
    all blocks of its shard."""
    sizes = shards.groupBy("pair", "x", "y").agg(F.ceil(F.count(F.lit(1)) / F.lit(crowd)).alias("blocks")).filter("blocks > 1")
    sized = shards.join(stored(sizes, "crowds"), ["pair", "x", "y"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
    own = sized.withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return met.select("pair", "x", "y", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fingerprint")


def fingerprint_links(prints: DataFrame, radius: int, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between different fingerprints (one row each) that hold all groups together."""
    keys = ("pair", "x", "y", "low", "high")
    dealt = _block_pairs(_shards(prints, radius), crowd).repartition(*keys).sortWithinPartitions(*keys, "fingerprint")

    def forest(shard: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        members = np.concatenate(shard)
        low, high = links(members.view(np.uint64)[:, None], radius)
        return members[low], members[high]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []  # the last shard of a batch may go on in the next one
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            new = np.any([np.diff(c) != 0 for c in columns[: len(keys)]], axis=0)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            ones, twos = [], []
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                this = tuple(c[begin] for c in columns[: len(keys)])
                if this != key:
                    if sum(map(len, held)) > 1:
                        a, b = forest(held)
                        ones.append(a)
                        twos.append(b)
                    key, held = this, []
                held.append(columns[-1][begin:end])
            if ones:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ones, twos)], names=["a", "b"])
        if sum(map(len, held)) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(held)], names=["a", "b"])

    return dealt.mapInArrow(run, "a BIGINT, b BIGINT")


def _least_of_groups(rows: DataFrame, radius: int) -> DataFrame:
    """(fingerprint, least): the least ``id`` of all rows (id, fingerprint) of the fingerprint's group."""
    prints = rows.groupBy("fingerprint").agg(F.min("id").alias("least"))
    found = connected_components(fingerprint_links(prints.select("fingerprint"), radius))
    groups = stored(found.select(F.col("node").alias("fingerprint"), F.col("component").alias("group")), "groups")
    named = prints.join(groups, "fingerprint", "left").select("fingerprint", F.coalesce("group", "fingerprint").alias("group"), "least")
    least = named.groupBy("group").agg(F.min("least").alias("least"))
    return named.drop("least").join(least, "group").select("fingerprint", "least")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) for each row of ``docs``."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    named = rows.join(_least_of_groups(rows, radius), "fingerprint")
    text = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return named.select(F.col("id").alias(id_col), text, F.col("least").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group of near-copies.

    Rows that are alone in their group are told by a filter of fixed size and stay where they are; the others meet the first rows of
    all groups."""
    whole = F.xxhash64(*[col(c) for c in docs.columns])
    asked = docs.select(F.struct(col(id_col).isNull().alias("none"), col(id_col).alias("id"), whole.alias("row")).alias("key"), col(text_col).cast("string").alias("text"))
    slim = stored(fingerprints(asked, "key", "text", shingle).withColumnRenamed("id", "key"), "fingerprints")
    prints = slim.select("fingerprint").distinct()
    found = connected_components(fingerprint_links(prints, radius))
    groups = stored(found.select(F.col("node").alias("fingerprint"), F.col("component").alias("group")), "groups")
    named = slim.join(groups, "fingerprint", "left").select("key", F.coalesce("group", "fingerprint").alias("group"))
    first = stored(named.groupBy("group").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "first")
    members = stored(named.join(first, "group").select(F.col("key.id").alias("id"), F.col("key.row").alias("row"), (F.col("key") == F.col("first")).alias("first")).distinct(), "members")
    in_several = BitFilter(members.select("row"))
    alone = in_several.rows(docs, whole, hit=False)
    others = in_several.rows(docs, whole).select(col(id_col).alias("id"), whole.alias("hash"), F.struct("*").alias("row"))
    told = members.select(F.col("id").alias("member_id"), F.col("row").alias("member_row"), "first")
    met = stored(others.join(told, (F.col("hash") == F.col("member_row")) & F.col("id").eqNullSafe(F.col("member_id")), "left"), "others")
    passed = met.filter("first IS NULL").select("row.*")
    kept = met.filter("first").dropDuplicates(["id", "hash"]).select("row.*")
    return alone.unionByName(passed).unionByName(kept)

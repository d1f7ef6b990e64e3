"""URL rules by a Bloom filter cascade.

A rule is a host and the beginning of a path. A URL's candidate keys are its host and the host's
parent domains, each with the URL's path cut to the lengths that rule paths have. A rule fits exactly
if its key is among them, so judging a URL needs set membership only, and the key that is found spells
the rule itself: no join, and nothing but filters reaches the tasks.

The cascade (Larisch et al., "CRLite", 2017) tells listed keys from every other key of the corpus
without error: level 1 holds the listed keys, level 2 those corpus keys that pass level 1 by mistake,
level 3 the listed keys that pass level 2, and so on until no mistake is left. Of a rule list one
cascade holds the rules that block and one those that allow; a key is in at most one of them.

Sizes: level 1 takes about 1.44 log2(1 / rate) bits for a listed key, and ``rate`` falls with the
number of corpus keys for each listed one, so the levels behind it hold about as many keys as the
list. The built filters are checked against ``MAX_BYTES`` before they are broadcast; a longer list is
an error, never a guess.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule. Host
is what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
path is what follows up to ``?``, ``#`` or the end. Empty hosts fit no rule. URLs without a rule get
the verdict "allow": no listed key is among theirs. Equal rules count once; of two rules with the same
key and different verdicts the blocking one counts. Repeated rows and null ids are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.llm.frames import col

#: Limit of what is broadcast.
MAX_BYTES = 64 << 20
#: Chance that a key passes a level by mistake, from level 2 on.
RATE = 0.5
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Bloom:
    """Bits of one level; keys are 64-bit hashes, and the level's number makes its probes its own."""

    def __init__(self, level: int, hashes: np.ndarray, rate: float) -> None:
        self.level, self.n_probes = level, max(1, round(-np.log2(rate)))
        self.n_bits = max(64, int(np.ceil(len(hashes) * self.n_probes / np.log(2))))
        bits = np.zeros(self.n_bits, dtype=bool)
        for at in self._probes(hashes):
            bits[at] = True
        self.bits = np.packbits(bits, bitorder="little")

    def _probes(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        one = (hashes ^ (hashes >> np.uint64(31))) * _MULTIPLIERS[0]
        two = ((hashes + np.uint64(self.level)) * _MULTIPLIERS[1]) | np.uint64(1)
        two ^= two >> np.uint64(29)
        for k in range(self.n_probes):
            mixed = one + np.uint64(k + 1 + 64 * self.level) * two
            yield ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(self.n_bits)).astype(np.int64)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for at in self._probes(hashes):
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return found


class Cascade:
    """Levels that decide membership for every key of the corpus."""

    def __init__(self) -> None:
        self.levels: list[Bloom] = []

    def __contains__(self, key_hash: int) -> bool:
        return bool(self.member(np.array([key_hash], dtype=np.uint64))[0])

    @property
    def n_bytes(self) -> int:
        return sum(len(x.bits) for x in self.levels)

    def member(self, hashes: np.ndarray) -> np.ndarray:
        """A key is listed if the first level it fails is an even one, or none and the last is odd."""
        found, open_ = np.zeros(len(hashes), dtype=bool), np.arange(len(hashes))
        for number, level in enumerate(self.levels, 1):
            passed = level.passes(hashes[open_])
            found[open_[~passed]] = number % 2 == 0
            open_ = open_[passed]
        found[open_] = len(self.levels) % 2 == 1
        return found


def key_hashes(keys: F.Column) -> F.Column:
    return F.xxhash64(keys)


def build_cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_BYTES) -> Cascade:
    """The cascade of the listed keys (a column ``key``) against all other keys of ``universe``.

    Listed keys are collected, as the filter itself is about their size. Of the corpus only keys that
    pass a level by mistake are, about as many as are listed.
    """
    spark = universe.sparkSession
    inside = np.array([r[0] for r in listed.select(key_hashes(F.col("key"))).distinct().limit(max_bytes // 8 + 1).collect()], dtype=np.int64).view(np.uint64)
    if len(inside) > max_bytes // 8:
        raise ValueError(f"the list has over {max_bytes // 8} keys")
    cascade = Cascade()
    if not len(inside):
        return cascade
    others = universe.select(key_hashes(F.col("key")).alias("h")).distinct()
    others = others.persist()
    rate = min(0.5, RATE**0.5 * len(inside) / max(1, others.count()))
    cascade.levels.append(Bloom(1, inside, rate))
    first = spark.sparkContext.broadcast((cascade.levels[0], np.sort(inside)))

    def mistakes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, known = first.value
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            wrong = h[level.passes(h) & (known[np.searchsorted(known, h) % len(known)] != h)]
            yield pa.RecordBatch.from_arrays([pa.array(wrong.view(np.int64))], names=["h"])

    wrong = others.mapInArrow(mistakes, "h BIGINT").limit(max_bytes // 8 + 1).collect()
    others.unpersist()
    if len(wrong) > max_bytes // 8:
        raise ValueError("too many keys pass level 1 by mistake")
    outside = np.array([r[0] for r in wrong], dtype=np.int64).view(np.uint64)
    held, rest = inside, outside  # level n keeps its own keys in, the other side's mistakes go on
    while len(rest):
        level = Bloom(len(cascade.levels) + 1, rest, RATE)
        cascade.levels.append(level)
        held, rest = rest, held[level.passes(held)]
    if cascade.n_bytes > max_bytes:
        raise ValueError(f"the cascade takes {cascade.n_bytes} bytes")
    return cascade


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    begin = F.locate("://", url)
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def candidate_keys(host: F.Column, path: F.Column, path_lengths: list[int]) -> F.Column:
    """All keys that a fitting rule can have, longest first: the host and its parents by the path cuts."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.array(*[F.lit(n) for n in path_lengths])
    cuts = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    keys = F.flatten(F.transform(parents, lambda h: F.transform(cuts, lambda p: F.concat(h, p))))
    ordered = F.array_sort(F.transform(F.array_distinct(keys), lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))))
    return F.when(host != "", F.transform(ordered, lambda x: x["k"])).otherwise(F.array().cast("array<string>"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of each row. ``rules`` holds (verdict, host, path); the longest
    fitting one decides."""
    spark = pages.sparkSession
    verdicts: dict[str, str] = {}
    for verdict, host, path in rules:
        key = host.lower() + path
        verdicts[key] = "block" if "block" in (verdict, verdicts.get(key)) else verdict
    host, path = host_and_path(col(url_col))
    parted = pages.select(col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    lengths = sorted({len(p) for _, _, p in rules}, reverse=True)
    if not lengths:
        return parted.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    universe = parted.select("host", "path").distinct().select(F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)).alias("key")).distinct()
    cascades = []
    for kind in ("block", "allow"):
        listed = spark.createDataFrame([(k,) for k, v in verdicts.items() if v == kind], "key STRING")
        cascades.append(build_cascade(listed, universe))
    filters = spark.sparkContext.broadcast(cascades)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocked, allowed = filters.value
        for batch in batches:
            ends = batch.column(4).offsets.to_numpy()
            hashes = batch.column(4).values.to_numpy(zero_copy_only=False).view(np.uint64)
            keys = batch.column(3).values
            hit = np.stack([c.member(hashes) if c.levels else np.zeros(len(hashes), bool) for c in (blocked, allowed)])
            at = np.append(np.flatnonzero(hit.any(axis=0)), len(hashes))
            found = at[np.searchsorted(at, ends[:-1])]  # the first, which is the longest, of each row
            has = found < ends[1:]
            rule = [keys[i].as_py() if ok else None for i, ok in zip(found.tolist(), has, strict=True)]
            verdict = ["block" if ok and hit[0, i] else "allow" for i, ok in zip(found.tolist(), has, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

    keyed = parted.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    keyed = keyed.withColumn("hashes", F.transform("keys", key_hashes))
    kind = parted.schema["id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"`{id_col}` {kind}, host STRING, path STRING, rule STRING, verdict STRING")

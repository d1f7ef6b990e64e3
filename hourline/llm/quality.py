"""Quality classifier by importance resampling.

Two generative models over hashed words and word pairs, one of labelled good text (target) and one of
the whole corpus (raw), give every document the log of its importance weight p_target / p_raw. Counts
are shrunk towards the raw model, so that an n-gram too rare to tell says little, and a document's
log weight is divided by the root of its length, as its n-grams aren't independent. Gumbel noise from
the document's own hash turns the k largest weights into a weighted sample without replacement
(Gumbel top-k); a low temperature keeps the noise to close decisions.

A second importance ratio, of text labelled as toxic to text labelled as clean, works the other way. Over a whole text the few words that
tell would drown, so it counts them alone: n-grams at least e^``TELLING`` times as frequent, by documents, in toxic text. The sum over a
document's different ones is its evidence, and documents whose evidence is beyond that of nearly all clean held-out ones are rejected
whatever their weight.

k is the number of documents whose weight reaches that of the worst ``1 - recall`` part of labelled
target documents which the models weren't fitted on, so it follows what the corpus holds. The k-th key
is found exactly by counting key prefixes, 16 bits a pass: keys are neither sorted nor collected.

Defined results: a null text counts as empty and has log weight 0; a null id draws its noise from
the text alone; rows that agree in id and text draw the same noise, and ties at the k-th key all
stay; with no labelled target document every document stays; an empty table gives an empty one.
Contradicting labels of one id make it no target, neither toxic nor clean; without toxic labels nothing tells. All columns of the input are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourline.llm.frames import col, fresh, stored, utf8, with_added
from hourline.llm.ngrams import ngram_buckets

#: Hash buckets of the n-gram models: the size of what is collected and broadcast.
BUCKETS = 1 << 16
#: At most so many labelled target documents are fitted on, those with the smallest id hash.
MAX_LABELLED = 20_000
#: One of so many labelled target documents is held out to set k; the models aren't fitted on it.
HELD_OUT = 5
#: Share of the held-out documents whose weights are at least the k-th one.
RECALL = 0.998
#: Log ratio from which an n-gram tells of a class, and how many such n-grams are broadcast at most, the strongest ones.
TELLING, MAX_TELLING = 1.5, 100_000
#: N-grams are known by so many hash values; ``BUCKETS`` divides it.
GRAMS = 1 << 40
#: Counts added to an n-gram's target count and to what the raw model expects there.
SHRINKAGE = 2.0
TEMPERATURE = 0.2


def target_ids(labels: DataFrame, id_col: str = "doc_id", good: str = "quality = 1 AND toxic = 0", limit: int = MAX_LABELLED) -> DataFrame:
    """(id, held_out): at most ``limit`` distinct ids for which every label row says good."""
    each = labels.filter(col(id_col).isNotNull()).groupBy(col(id_col).alias("id"))
    ids = each.agg(F.min(F.expr(good).cast("int")).alias("good"), F.count(F.expr(good)).alias("n"), F.count(F.lit(1)).alias("rows"))
    ids = ids.filter("good = 1 AND n = rows").orderBy(F.xxhash64("id"), "id").limit(limit)
    return ids.select("id", (F.pmod(F.hash("id"), F.lit(HELD_OUT)) == 0).alias("held_out"))


def telling_grams(docs: DataFrame, bad: DataFrame, clean: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, log ratios) of the n-grams that tell text of ``bad`` ids from text of ``clean`` ones (id, held_out), in ascending order."""
    marks = F.broadcast(bad.filter("NOT held_out").select("id", F.lit(True).alias("bad")).unionByName(clean.filter("NOT held_out").select("id", F.lit(False).alias("bad"))))
    rows = stored(docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).join(marks, "id").select("bad", "text"), "quality-marked")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            is_bad, seen = np.array(batch.column(0).to_pylist(), dtype=bool), []
            for numbers, grams in ngram_buckets(utf8(batch.column(1)), GRAMS):
                seen.append(np.unique(np.stack([grams, numbers], axis=1), axis=0))
            pairs = np.unique(np.concatenate(seen), axis=0) if seen else np.empty((0, 2), np.int64)
            gram, at = np.unique(pairs[:, 0], return_inverse=True)
            n_bad = np.bincount(at, is_bad[pairs[:, 1]], len(gram)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"gram": gram, "bad": n_bad, "clean": np.bincount(at, minlength=len(gram)) - n_bad})

    sizes = rows.agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("clean")).first()
    if not sizes["bad"] or not sizes["clean"]:
        return np.empty(0, np.int64), np.empty(0)
    sums = rows.mapInArrow(count, "gram BIGINT, bad BIGINT, clean BIGINT").groupBy("gram").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean"))
    ratio = F.log((F.col("bad") + SHRINKAGE) / (F.col("clean") * F.lit(sizes["bad"] / sizes["clean"]) + SHRINKAGE))
    found = sums.select("gram", ratio.alias("ratio")).filter(F.col("ratio") >= TELLING).orderBy(F.desc("ratio"), "gram").limit(MAX_TELLING).toPandas().sort_values("gram")
    return found["gram"].to_numpy(np.int64), found["ratio"].to_numpy(float)


def _flagged(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ids = F.broadcast(ids.filter("NOT held_out").select(F.col("id"), F.lit(True).alias("target")))  # MAX_LABELLED rows at most
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return rows.join(ids, "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))


def fit(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_buckets: int = BUCKETS) -> np.ndarray:
    """The log ratio of the two models by bucket; counts are taken over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)
        for batch in batches:
            good = np.array(batch.column("target").to_pylist(), dtype=bool)
            for numbers, grams in ngram_buckets(utf8(batch.column("text")), GRAMS):
                buckets = grams % n_buckets
                raw += np.bincount(buckets, minlength=n_buckets)
                target += np.bincount(buckets[good[numbers]], minlength=n_buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(seen, pa.int32()), "target": target[seen], "raw": raw[seen]})

    sums = _flagged(docs, ids, id_col, text_col).mapInArrow(count, "bucket INT, target BIGINT, raw BIGINT")
    sums = sums.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).collect()  # n_buckets rows at most
    target, raw = np.zeros(n_buckets), np.zeros(n_buckets)
    for r in sums:
        target[r.bucket], raw[r.bucket] = r.target, r.raw
    if not target.any():
        return np.zeros(n_buckets)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + SHRINKAGE) / (expected + SHRINKAGE))


def score(docs: DataFrame, log_ratio: np.ndarray, telling: tuple[np.ndarray, np.ndarray], text_col: str = "text", weight_col: str = "log_weight", evidence_col: str = "evidence") -> DataFrame:
    """All rows and columns, with the whole text's log importance weight over the root of its length, and its evidence of toxic text."""
    shared = docs.sparkSession.sparkContext.broadcast((log_ratio, *telling))
    at = docs.columns.index(text_col)
    schema = with_added(docs, [T.StructField(c, T.DoubleType()) for c in (weight_col, evidence_col)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket, known, strength = shared.value
        for batch in batches:
            n = batch.num_rows
            weights, sizes, told = np.zeros(n), np.zeros(n), [np.empty(0, np.int64)]
            for numbers, grams in ngram_buckets(utf8(batch.column(at)), GRAMS):
                weights += np.bincount(numbers, weights=by_bucket[grams % len(by_bucket)], minlength=n)
                sizes += np.bincount(numbers, minlength=n)
                if len(known):
                    place = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                    hit = known[place] == grams
                    told.append(numbers[hit] * len(known) + place[hit])
            pairs = np.unique(np.concatenate(told))  # each n-gram of a text once
            evidence = np.bincount(pairs // len(known), strength[pairs % len(known)], n) if len(pairs) else np.zeros(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights / np.sqrt(np.maximum(sizes, 1))), pa.array(evidence)], names=schema.names)

    return docs.mapInArrow(add, schema)


def _noise(id_col: str, text_col: str, seed: int) -> F.Column:
    """Standard Gumbel noise from the row's own hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), col(id_col), F.coalesce(col(text_col).cast("string"), F.lit(""))), 12)
    u = (bits.cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def _fixed(key: F.Column) -> F.Column:
    """A key in units of 2**-20, as an integer: what the order of keys is decided by."""
    return F.floor(key * F.lit(float(1 << 20))).cast("bigint")


def kth_largest(numbers: DataFrame, k: int, name: str = "number") -> int | None:
    """The k-th largest BIGINT of a column, exactly: counts of 16-bit prefixes, four passes."""
    top = 1 << 63
    raw = numbers.select(F.col(name).bitwiseXOR(F.lit(-top).cast("bigint")).alias("u"))  # orders as unsigned
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        rows = raw if shift == 48 else raw.filter(F.shiftrightunsigned("u", shift + 16) == F.lit(prefix))
        digit = F.shiftrightunsigned("u", shift).bitwiseAND(F.lit(0xFFFF).cast("bigint"))
        counts = sorted(rows.groupBy(digit.alias("d")).count().collect(), reverse=True)  # 65,536 rows at most
        for r in counts:
            if left <= r["count"]:
                prefix = (prefix << 16) | r.d
                break
            left -= r["count"]
        else:
            return None
    return prefix - top


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL, seed: int = 7, n_buckets: int = BUCKETS) -> DataFrame:
    """The sampled documents, with all their columns and ``log_weight`` and ``key`` behind them."""
    weight_col, key_col, evidence_col = fresh(docs, "log_weight"), fresh(docs, "key"), fresh(docs, "evidence")
    ids = stored(target_ids(labels, id_col), "quality-ids")
    bad, clean = (stored(target_ids(labels, id_col, f"toxic = {t}"), "quality-ids") for t in (1, 0))
    telling = telling_grams(docs, bad, clean, id_col, text_col)
    log_ratio = fit(docs, ids, id_col, text_col, n_buckets)
    scored = score(docs, log_ratio, telling, text_col, weight_col, evidence_col)
    scored = scored.withColumn(key_col, col(weight_col) / TEMPERATURE + _noise(id_col, text_col, seed))
    slim = score(docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")), log_ratio, telling)
    number = _fixed(F.col("log_weight") / TEMPERATURE + _noise("id", "text", seed)).alias("number")
    keys = stored(slim.select("id", "log_weight", "evidence", number), "quality-keys")

    def held_out(marked: DataFrame) -> DataFrame:
        held = keys.join(F.broadcast(marked), "id")  # MAX_LABELLED ids at most
        return held.filter("held_out") if marked.filter("held_out").head(1) else held

    usual = held_out(clean).agg(F.expr(f"percentile(evidence, {recall})")).first()[0] or 0.0
    passed = scored.filter(~((col(evidence_col) > F.lit(float(usual))) & (col(evidence_col) >= TELLING))).drop(col(evidence_col))
    lowest = held_out(ids).agg(F.expr(f"percentile(log_weight, {1 - recall})")).first()[0]
    if lowest is None:
        return passed
    threshold = kth_largest(keys, keys.filter(F.col("log_weight") >= lowest).count())
    return passed.filter(_fixed(col(key_col)) >= F.lit(threshold))

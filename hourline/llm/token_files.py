"""Token files with keyed access: raw id payloads behind a minimal perfect hash.

A file is a folder of two tables, written and read by Spark.

* ``shards``: one row for each shard, which holds documents in ascending key order. ``payload`` has
  all ids, little-endian, ``width`` bytes each; ``ends`` the end of each document in the payload, in
  ids (uint64). ``seeds`` (int32), ``prints`` (uint32), ``rows`` and ``copies`` (uint32) are the index:
  a key's hash picks a seed; a seed under 0 names the key's slot, another one hashes the key to its
  slot. There are as many slots as different keys. A slot holds the fingerprint of its key, its first
  document and how many documents in a row have that key. ``keys`` lists the documents' keys.
* ``parts``: shards are written by key range. ``start`` is the number of ids before a range, and a
  shard's ``start`` counts from there.

Reading a key costs two hashes and one slice; a key that isn't there is told by its fingerprint, or by
the key list where the caller wants to be sure. Nothing is sorted by one task: ranges come from key
quantiles, encoding happens before the shuffle, and only ids are shuffled.

A key, or null, that has more rows than a range should hold is dealt over several ranges, and a shard ends anywhere, also between
equal keys. So neither a task nor a cell grows with a key's rows; each shard indexes what it holds of a key, and a keyed read
asks all shards that may hold some.

Defined results: a null text counts as empty and holds the end id alone. Documents of equal key stay
together, ordered by their ids within a range; a null key sorts before all others and is a key like any other. An
empty table gives no shards.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from hourline.llm.frames import col, utf8
from hourline.llm.words import PLAIN, in_alphabet

#: Ids of a shard; a shard ends with the document that reaches it.
SHARD_IDS = 4_000_000
#: Shards of a file: their first keys are broadcast for keyed reads. More need larger shards.
MAX_SHARDS = 1 << 20
#: Chunks whose ids a task keeps, and bytes of texts that it encodes at once.
KEPT_WORDS, PIECE = 600_000, 1 << 22
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_NULL = np.uint64(0x5DEECE66D)
SHARD_SCHEMA = (
    "part INT, shard INT, start BIGINT, width INT, first_key BIGINT, first_null BOOLEAN, last_key BIGINT, n_docs BIGINT, n_ids BIGINT, "
    "payload BINARY, ends BINARY, seeds BINARY, prints BINARY, rows BINARY, copies BINARY, keys BINARY, nulls BIGINT"
)


class _Lists:
    """Lists of ids by number, side by side in one array; number 0 is an empty one."""

    def __init__(self) -> None:
        self._ids, self._ends = np.empty(0, np.int64), np.zeros(2, np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self._ends = np.append(self._ends, self._ends[-1] + np.cumsum(sizes))
        self._ids = np.append(self._ids, ids)

    def sizes(self, numbers: np.ndarray) -> np.ndarray:
        return self._ends[numbers + 1] - self._ends[numbers]

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The lists of these numbers, one after another."""
        size = self.sizes(numbers)
        upto = np.cumsum(size)
        return self._ids[np.arange(upto[-1] if len(upto) else 0) + np.repeat(self._ends[numbers] - (upto - size), size)]


class LibraryEncoder:
    """Ids by the library, chunk by chunk: a text is cut at ASCII white space, each different chunk of many texts has a number, and the ids of a
    chunk are kept by its number.

    Most new chunks are letters of Latin-1 with marks behind them. Their words and marks need no Unicode tables, and those that are new
    go through the library's model in one call. Other chunks go through the whole library, in one call too, but for those with added tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each core has a task of its own
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        encode = self._library.encode
        if encode("a \n b", add_special_tokens=False).ids != encode("a", add_special_tokens=False).ids + encode("b", add_special_tokens=False).ids:
            raise ValueError("a vocabulary that keeps white space can't be encoded chunk by chunk")
        self._words = Tokenizer(self._library.model)  # takes words as the normalizer and pre-tokenizer leave them
        self._words.pre_tokenizer = WhitespaceSplit()
        self._added = re.compile(b"|".join(re.escape(t.content.encode()) for t in self._library.get_added_tokens_decoder().values()) or b"(?!)")
        self._forget()

    def _forget(self) -> None:
        self._number: dict[bytes, int] = {}
        self._part: dict[str, int] = {"": 0}
        self._chunks, self._parts = _Lists(), _Lists()

    def _learn(self, chunks: list[bytes]) -> None:
        """Number new chunks and keep their ids."""
        plain, others = [], []
        for chunk in chunks:
            found = PLAIN.fullmatch(chunk.decode().lower())
            if found is None:
                others.append(chunk)
            else:
                plain.append((chunk, found[1], found[2]))
        if plain:
            new = [p for p in dict.fromkeys(p for _, word, marks in plain for p in (word, marks)) if p not in self._part]
            if new:
                found = self._words.encode(" ".join(in_alphabet(p) for p in new), add_special_tokens=False)
                self._part.update(zip(new, range(len(self._part), len(self._part) + len(new)), strict=True))
                self._parts.add(np.array(found.ids, np.int64), np.bincount(np.array(found.word_ids, np.int64), minlength=len(new)))
            pairs = np.array([(self._part[word], self._part[marks]) for _, word, marks in plain], np.int64)
            self._keep([c for c, _, _ in plain], self._parts.gather(pairs.ravel()), self._parts.sizes(pairs).sum(axis=1))
        for chunk in [c for c in others if self._added.search(c)]:
            ids = np.array(self._library.encode(chunk.decode(), add_special_tokens=False).ids, np.int64)
            self._keep([chunk], ids, np.array([len(ids)]))
        others = [c for c in others if not self._added.search(c)]
        if others:
            texts = [c.decode() for c in others]
            found = self._library.encode(" ".join(texts), add_special_tokens=False)
            begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
            at = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
            self._keep(others, np.array(found.ids, np.int64), np.diff(np.searchsorted(at, begins)))

    def _keep(self, chunks: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self._number) + 1
        self._number.update(zip(chunks, range(n, n + len(chunks)), strict=True))
        self._chunks.add(ids, sizes)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's end)."""
        if len(self._number) > KEPT_WORDS:
            self._forget()
        words = [t.split() for t in texts]
        known = self._number.get
        numbers = [np.fromiter(map(known, w, repeat(-1)), np.int64, len(w)) for w in words]
        missing = [(k, np.flatnonzero(n < 0)) for k, n in enumerate(numbers)]
        new = dict.fromkeys(words[k][i] for k, at in missing for i in at.tolist())
        if new:
            self._learn(list(new))
            known = self._number.__getitem__
            for k, at in missing:
                numbers[k][at] = [known(words[k][i]) for i in at.tolist()]
        whole = np.concatenate([np.empty(0, np.int64), *numbers])
        ids = self._chunks.gather(whole)
        text_ends = np.append(0, np.cumsum(self._chunks.sizes(whole)))[np.cumsum([len(w) for w in words])]
        return ids, text_ends


@lru_cache(maxsize=2)
def _library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _some(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Texts that are encoded at once: PIECE bytes or one."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > PIECE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def key_hash(keys: np.ndarray, nulls: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """64-bit hash of integer keys under a seed; a null key hashes as a constant of its own."""
    h = np.where(nulls, _NULL, keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h = h + (np.atleast_1d(seed).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)  # wraps around
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def fingerprints(keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    return (key_hash(keys, nulls, 0x7FFFFFFF) >> np.uint64(32)).astype(np.uint32)


def build_index(keys: np.ndarray, nulls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, slot of each key) for different keys: buckets of several keys try seeds until all their
    keys fall on free slots, largest buckets first; buckets of one key name a free slot."""
    n = len(keys)
    seeds, slots, taken = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
    if not n:
        return seeds, slots
    buckets = (key_hash(keys, nulls, 0) % np.uint64(n)).astype(np.int64)
    order = np.argsort(buckets, kind="stable")
    begins = np.flatnonzero(np.diff(buckets[order], prepend=-1))
    sizes = np.diff(np.append(begins, n))
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] == 1:
            break
        members = order[begins[b] : begins[b] + sizes[b]]
        seed = 1
        while True:
            at = (key_hash(keys[members], nulls[members], seed) % np.uint64(n)).astype(np.int64)
            if not taken[at].any() and len(set(at.tolist())) == len(at):
                break
            seed += 1
        seeds[buckets[members[0]]], slots[members], taken[at] = seed, at, True
    alone = order[begins[sizes == 1]]
    free = np.flatnonzero(~taken)[: len(alone)]
    seeds[buckets[alone]], slots[alone] = -free - 1, free
    return seeds, slots


def slots_of(keys: np.ndarray, nulls: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The slot of each key: two hashes."""
    n = np.uint64(len(seeds))
    seed = seeds[(key_hash(keys, nulls, 0) % n).astype(np.int64)]
    return np.where(seed < 0, -seed.astype(np.int64) - 1, (key_hash(keys, nulls, np.maximum(seed, 0)) % n).astype(np.int64))


def _shard(part: int, number: int, start: int, width: int, docs: list[tuple[int | None, bytes]]) -> dict:
    nulls = np.array([k is None for k, _ in docs])
    keys = np.array([k or 0 for k, _ in docs], dtype=np.int64)
    fresh = np.append(True, (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1]))
    first = np.flatnonzero(fresh)
    seeds, slots = build_index(keys[first], nulls[first])
    prints, rows, copies = (np.zeros(len(first), "<u4") for _ in range(3))
    prints[slots], rows[slots] = fingerprints(keys[first], nulls[first]), first
    copies[slots] = np.diff(np.append(first, len(docs)))
    ends = np.cumsum([len(ids) // width for _, ids in docs])
    return {
        "part": part, "shard": number, "start": start, "width": width, "first_key": int(keys[0]), "first_null": bool(nulls[0]), "last_key": int(keys[-1]), "n_docs": len(docs), "n_ids": int(ends[-1]),
        "payload": b"".join(ids for _, ids in docs), "ends": ends.astype("<u8").tobytes(), "seeds": seeds.astype("<i4").tobytes(), "prints": prints.tobytes(), "rows": rows.tobytes(),
        "copies": copies.tobytes(), "keys": keys.astype("<i8").tobytes(), "nulls": int(nulls.sum()),
    }


def _one_row(values: dict) -> pa.RecordBatch:
    kinds = {"INT": pa.int32(), "BIGINT": pa.int64(), "BINARY": pa.binary(), "BOOLEAN": pa.bool_()}
    fields = [f.split() for f in SHARD_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([values[n]], kinds[t]) for n, t in fields], names=[n for n, _ in fields])


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, width: int = 2) -> None:
    """Encode whole texts, append ``end_id`` to each, and write the file to ``path``."""
    spark = docs.sparkSession
    rows = docs.select(col(id_col).cast("bigint").alias("key"), col(text_col).cast("string").alias("text"))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / n_parts) for i in range(1, max(2, n_parts))])
    found = docs.select(col(id_col).cast("bigint").alias("key")).agg(F.percentile_approx("key", shares, 10_000), F.count("key"), F.count(F.lit(1))).first()
    bounds = np.array(found[0] or [], dtype=np.int64)  # a key for each shuffle partition but the last; frequent keys several times
    null_parts = max(1, -(-(found[2] - found[1]) * n_parts // max(1, found[2])))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, end, rows_seen = _library(tokenizer), np.array([end_id], dtype=f"<u{width}").tobytes(), 0
        for batch in batches:
            ids = []
            for texts in _some(utf8(batch.column(1))):
                found, ends = library.encode(texts)
                if found.size and int(found.max()) >= 1 << 8 * width:
                    raise ValueError(f"an id doesn't fit in {width} bytes")
                payload, ends = found.astype(f"<u{width}").tobytes(), (ends * width).tolist()
                ids += [payload[a:b] + end for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            nulls = np.array(batch.column(0).is_null().to_pylist(), dtype=bool)
            keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            low, high = (np.searchsorted(bounds, keys, side=side) for side in ("left", "right"))
            width_of = np.where(nulls, null_parts, np.maximum(1, high - low))  # ranges of the key
            salt = (np.arange(rows_seen, rows_seen + len(keys), dtype=np.uint64) * _MIX[0] >> np.uint64(40)).astype(np.int64)
            part = np.where(nulls, 0, null_parts + low) + salt % width_of
            rows_seen += len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column(0), pa.array(ids, pa.binary())], names=["part", "key", "ids"])

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start, size, held = -1, 0, 0, 0, []
        for batch in batches:
            for p, key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (p != part or size >= shard_ids):
                    yield _one_row(_shard(part, number, start, width, held))
                    number, start, size, held = (0, 0, 0, []) if p != part else (number + 1, start + size, 0, [])
                part = p
                held.append((key, ids))
                size += len(ids) // width
        if held:
            yield _one_row(_shard(part, number, start, width, held))

    encoded = rows.mapInArrow(encode, "part INT, key BIGINT, ids BINARY")
    dealt = encoded.repartitionById(null_parts + len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("key"), "ids")
    dealt.mapInArrow(to_shards, SHARD_SCHEMA).write.parquet(f"{path}/shards")
    sums = spark.read.parquet(f"{path}/shards").groupBy("part").agg(F.sum("n_ids").alias("n_ids"), F.count(F.lit(1)).alias("n_shards"))
    before, parts = 0, []
    for r in sums.orderBy("part").collect():  # a row for each shuffle partition
        parts.append((r.part, before, r.n_shards))
        before += r.n_ids
    spark.createDataFrame(parts, "part INT, start BIGINT, n_shards BIGINT").coalesce(1).write.parquet(f"{path}/parts")


def _open(spark: SparkSession, path: str) -> tuple[DataFrame, dict[int, int]]:
    parts = spark.read.parquet(f"{path}/parts").collect()
    return spark.read.parquet(f"{path}/shards"), {r.part: r.start for r in parts}


class Shard:
    """A shard in memory; ``find`` gives (start, ids) of the documents of a key."""

    def __init__(self, row: dict, start: int) -> None:
        self.start = start + row["start"]
        self.payload, self.width = row["payload"], row["width"]
        self.ends = np.frombuffer(row["ends"], "<u8").astype(np.int64)
        self.seeds, self.prints = np.frombuffer(row["seeds"], "<i4"), np.frombuffer(row["prints"], "<u4")
        self.rows, self.copies = np.frombuffer(row["rows"], "<u4"), np.frombuffer(row["copies"], "<u4")
        self.keys, self.n_null = np.frombuffer(row["keys"], "<i8"), row["nulls"]

    def find(self, keys: np.ndarray, nulls: np.ndarray, exact: bool = False) -> list[list[tuple[int, np.ndarray]]]:
        slots = slots_of(keys, nulls, self.seeds)
        known = self.prints[slots] == fingerprints(keys, nulls)
        if exact:
            at = self.rows[slots]
            known &= (self.keys[at] == np.where(nulls, 0, keys)) & ((at < self.n_null) == nulls)
        return [[self.document(r) for r in range(row, row + n)] if ok else [] for ok, row, n in zip(known, self.rows[slots], self.copies[slots], strict=True)]

    def document(self, row: int) -> tuple[int, np.ndarray]:
        begin = int(self.ends[row - 1]) if row else 0
        ids = np.frombuffer(self.payload, f"<u{self.width}", int(self.ends[row]) - begin, begin * self.width)
        return self.start + begin, ids.astype("<u4")


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, each fetched by its key through the index."""
    shards, starts = _open(spark, path)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in range(batch.num_rows):  # one shard in memory at a time
                row = batch.slice(number, 1).to_pylist()[0]
                shard = Shard(row, starts[row["part"]])
                nulls = np.arange(len(shard.keys)) < shard.n_null
                fresh = np.append(True, (shard.keys[1:] != shard.keys[:-1]) | (nulls[1:] != nulls[:-1]))
                keys, nulls = shard.keys[fresh], nulls[fresh]
                out = [(None if null else int(key), start, len(ids), zlib.crc32(ids.tobytes())) for key, null, found in zip(keys, nulls, shard.find(keys, nulls), strict=True) for start, ids in found]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(fetch, f"`{id_col}` BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT")


def lookup(spark: SparkSession, path: str, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """(key, start, ids) of the documents of the given keys; keys that aren't there give no row.

    The first keys of all shards are broadcast, so each key goes to its shard and meets it there."""
    shards, starts = _open(spark, path)
    heads = shards.select("first_null", "first_key", "part", "shard").limit(MAX_SHARDS + 1).collect()
    if len(heads) > MAX_SHARDS:
        raise ValueError(f"over {MAX_SHARDS} shards: write the file with larger ones")
    heads.sort(key=lambda r: (not r.first_null, r.first_key, r.part, r.shard))
    names = [(r.part, r.shard) for r in heads]
    first = np.array([r.first_key for r in heads if not r.first_null], dtype=np.int64)
    n_null = len(heads) - len(first)

    def address(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0)
            nulls = np.array(values.is_null().to_pylist(), dtype=bool)
            asked = values.fill_null(0).to_numpy(zero_copy_only=False)
            begin = np.where(nulls, 0, np.maximum(0, np.searchsorted(first, asked, side="left") - 1 + n_null))
            end = np.where(nulls, n_null, np.searchsorted(first, asked, side="right") + n_null)
            size = np.maximum(0, end - begin)  # all shards that may hold some of the key's documents
            at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
            parts = np.array([names[i] for i in at], dtype=np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([values.take(pa.array(np.repeat(np.arange(len(size)), size))), pa.array(parts[:, 0]), pa.array(parts[:, 1])], names=["key", "part", "shard"])

    wanted = keys.select(col(key_col).cast("bigint").alias("key")).distinct().mapInArrow(address, "key BIGINT, part INT, shard INT")

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        asked = left.column("key")
        if right.num_rows and left.num_rows:
            row = right.to_pylist()[0]
            nulls = np.array(asked.is_null().to_pylist(), dtype=bool)
            values = asked.fill_null(0).to_numpy()
            found = Shard(row, starts[row["part"]]).find(values, nulls, exact=True)
            out = [(None if null else int(k), start, ids.tolist()) for k, null, each in zip(values, nulls, found, strict=True) for start, ids in each]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int32()))], names=["key", "start", "ids"])

    met = wanted.groupBy("part", "shard").cogroup(shards.groupBy("part", "shard")).applyInArrow(fetch, "key BIGINT, start BIGINT, ids ARRAY<INT>")
    return met.withColumnRenamed("key", key_col)

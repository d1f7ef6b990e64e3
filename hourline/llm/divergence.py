"""Source divergence audit: how the sources of a language differ in their words.

The terms of a language that occur in at least ``min_docs`` of its documents are found as an iceberg:
for prefixes of 6, then 12 bytes, each level counts the documents that hold a term with the
prefix, and prefixes under the threshold go with all their longer ones, so that the many rare terms are
never shuffled in whole. A level's prefixes are known by a 64-bit hash, and those that stay go into a filter
of fixed size, which is all that is broadcast; what a collision or a full filter lets
through is counted by whole terms in the end, which decide exactly.

Term counts by source are smoothed into shares p = 1 + floor(10^9 (count + 1) / (N + V)) of the V kept terms, and
f = floor((p - q)^2 / q) is how far a term's share p in a source is from q. A source's sum of f against another
depends on a term through its two counts alone, so tasks count how many terms have each pair of counts in two
sources, and terms that one or both lack come in by differences: no term is expanded over sources that don't
have it. Such a term row holds one entry for each source that has it. All sums are exact whole numbers.

Defined results: null text, language and source count as ''. Repeated rows are documents of their own. A language
without kept terms gives its sources' pairs the value 0. An empty table gives no rows. A text of any length goes
through in pieces; its terms count one document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourline.llm.bit_filter import Sieve
from hourline.llm.frames import col, stored, utf8
from hourline.llm.rolling import ODD, Rolling, mix

#: Bytes of the prefixes of each level.
LEVELS = (6, 12)
MIN_DOCS, TOP = 3, 200
SCALE = 1_000_000_000
#: Bytes of texts that are parsed at once, sums that a task holds, pairs of sources that are counted at once.
PIECE, HELD, PAIRS = 1 << 21, 1 << 20, 1 << 21
_LETTER = np.array([b >= 0x80 or chr(b).isascii() and chr(b).isalpha() for b in range(256)])
_LOWER = np.array([b + 32 if ord("A") <= b <= ord("Z") else b for b in range(256)], dtype=np.uint8)


class Terms:
    """The terms of some texts, lower-cased: ``row``, ``start`` and ``length`` in bytes, and hashes of their prefixes."""

    def __init__(self, texts: list[bytes], rows: list[int]) -> None:
        self.data = _LOWER[np.frombuffer(b"\0".join([b"", *texts, b""]), dtype=np.uint8)]
        letter = _LETTER[self.data]
        edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        self.start, ends = edges[::2], edges[1::2]
        self.length = ends - self.start
        begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
        self.row = np.repeat(np.asarray(rows), np.diff(np.searchsorted(self.start, begins)))
        self._rolling = Rolling(self.data)

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """A 64-bit hash of each term's first ``longest`` bytes."""
        length = self.length if longest is None else np.minimum(self.length, longest)
        return self._rolling.hashes(self.start, length)

    def take(self, chosen: np.ndarray) -> None:
        self.start, self.length, self.row = self.start[chosen], self.length[chosen], self.row[chosen]

    def words(self, at: np.ndarray) -> pa.Array:
        """The chosen terms as a column of strings."""
        start, length = self.start[at], self.length[at]
        ends = np.cumsum(length)
        bytes_ = self.data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)]
        offsets = np.append(0, ends).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(bytes_))


def _pieces(texts: Iterable[bytes]) -> Iterator[tuple[list[bytes], list[int], bool]]:
    """(texts, rows, whether the last one goes on): whole texts up to PIECE bytes, longer ones in parts cut between terms."""
    held, rows, size = [], [], 0
    for row, text in enumerate(texts):
        if held and size + len(text) > PIECE:
            yield held, rows, False
            held, rows, size = [], [], 0
        begin = 0
        while len(text) - begin > PIECE:
            end = begin + PIECE
            while end < len(text) and _LETTER[text[end]]:
                end += 1
            yield [text[begin:end]], [row], True
            begin = end
        held.append(text[begin:])
        rows.append(row)
        size += len(text) - begin
    if held:
        yield held, rows, False


def _seeds(names: list[str]) -> np.ndarray:
    """A number for each language, the same in all tasks."""
    seen = {n: int.from_bytes(n.encode(), "little") % ((1 << 61) - 1) for n in set(names)}
    return mix(np.array([seen[n] for n in names], dtype=np.uint64) + ODD)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """The first place of each run of equal values."""
    new = np.zeros(max(0, len(columns[0]) - 1), dtype=bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.append(True, new)) if len(columns[0]) else np.empty(0, np.int64)


class _Sums:
    """Counts by key that a task has seen and not yet given on."""

    def __init__(self) -> None:
        self._parts: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> bool:
        """Whether it is time to give them on."""
        self._parts.append((keys, n))
        self._size += len(keys)
        if self._size <= 2 * HELD:
            return False
        self._parts = [self._added()]
        self._size = len(self._parts[0][0])
        return self._size > HELD

    def _added(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*self._parts, strict=True))
        order = np.argsort(keys, kind="stable")
        first = _firsts(keys[order])
        return keys[order][first], np.add.reduceat(n[order], first) if len(first) else n

    def take(self) -> pa.RecordBatch:
        keys, n = self._added() if self._parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self._parts, self._size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])


def _prefixes(docs: DataFrame, length: int, above: tuple[int, Sieve] | None) -> DataFrame:
    """(key, n): documents, by task, that hold a term of theirs with each prefix of ``length`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            seeds, open_ = _seeds(batch.column(0).to_pylist()), np.empty(0, np.uint64)
            for texts, rows, goes_on in _pieces(utf8(batch.column(2))):
                terms = Terms(texts, rows)
                if above is not None:
                    terms.take(above[1].stay(terms.hashes(above[0]) ^ seeds[terms.row]))
                row, key = terms.row, terms.hashes(length) ^ seeds[terms.row]
                if goes_on or len(open_):  # a text in parts: what they hold counts once
                    mine = row == rows[0]
                    open_ = np.union1d(open_, key[mine])
                    if goes_on:
                        continue
                    row, key, open_ = np.append(row[~mine], np.full(len(open_), rows[0])), np.append(key[~mine], open_), np.empty(0, np.uint64)
                code, keys = pd.factorize(key)
                pairs = pd.unique(row.astype(np.int64) * max(1, len(keys)) + code)
                if sums.add(keys, np.bincount(pairs % max(1, len(keys)), minlength=len(keys))):
                    yield sums.take()
        yield sums.take()

    return docs.mapInArrow(run, "key BIGINT, n BIGINT")


class _Held:
    """Counts of (language and source, term) that a task has seen, in arrays, and each different term once."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.known, self.marks, self.words = np.empty(0, np.uint64), np.empty(0, np.uint64), pa.array([], pa.string())
        self._parts: list[tuple[np.ndarray, ...]] = []  # key, term, group, docs, count

    def learn(self, terms: Terms, at: np.ndarray, hashes: np.ndarray) -> None:
        """Keep the bytes of new terms; terms of equal hash must be alike."""
        marks = _marks(terms, at)
        place = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        old = self.known[place] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        if not np.array_equal(self.marks[place[old]], marks[old]):
            raise ArithmeticError(_SHARED)
        known = np.append(self.known, hashes[~old])
        order = np.argsort(known, kind="stable")
        words = pa.chunked_array([self.words, terms.words(at[~old])]).combine_chunks()
        self.known, self.marks, self.words = known[order], np.append(self.marks, marks[~old])[order], words.take(pa.array(order))

    def add(self, term: np.ndarray, group: np.ndarray, docs: np.ndarray, count: np.ndarray) -> bool:
        """Whether it is time to give the counts on."""
        self._parts.append((mix(term ^ (group.astype(np.uint64) + np.uint64(1)) * ODD), term, group, docs, count))
        if sum(len(p[0]) for p in self._parts) > HELD:
            self._parts = [self._added()]
        return len(self._parts[0][0]) > HELD

    def _added(self) -> tuple[np.ndarray, ...]:
        key, term, group, docs, count = (np.concatenate(x) for x in zip(*self._parts, strict=True))
        order = np.argsort(key, kind="stable")
        first = _firsts(key[order])
        rep = order[first]
        return key[rep], term[rep], group[rep], np.add.reduceat(docs[order], first), np.add.reduceat(count[order], first)

    def take(self) -> Iterator[pa.RecordBatch]:
        if self._parts and sum(len(p[0]) for p in self._parts):
            _, term, group, docs, count = self._added()
            names = [pa.array([g[i] for g in self.groups], pa.string()) for i in (0, 1)]
            for k in range(0, len(term), 1 << 16):
                part = slice(k, k + (1 << 16))
                columns = [*(n.take(pa.array(group[part])) for n in names), self.words.take(pa.array(np.searchsorted(self.known, term[part]))), pa.array(docs[part]), pa.array(count[part])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "docs", "count"])
        self.__init__()


def _whole_terms(docs: DataFrame, length: int, sieve: Sieve) -> DataFrame:
    """(lang, source, term, docs, count) by task, of terms whose prefix stayed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            langs, sources = (batch.column(i).to_pylist() for i in (0, 1))
            seeds = _seeds(langs)
            before: set[bytes] = set()  # terms of earlier parts of a text that goes on
            for texts, rows, goes_on in _pieces(utf8(batch.column(2))):
                of = {r: held.groups.setdefault((langs[r], sources[r]), len(held.groups)) for r in rows}
                terms = Terms(texts, rows)
                terms.take(sieve.stay(terms.hashes(length) ^ seeds[terms.row]))
                term, hashes = pd.factorize(terms.hashes())
                first = np.full(len(hashes), len(term))
                np.minimum.at(first, term, np.arange(len(term)))
                marks = _marks(terms, np.arange(len(term)))
                if not np.array_equal(marks, marks[first[term]]):
                    raise ArithmeticError(_SHARED)
                held.learn(terms, first, hashes)
                pair, which = pd.factorize(terms.row.astype(np.int64) * max(1, len(hashes)) + term)
                count, row, which = np.bincount(pair, minlength=len(which)), which // max(1, len(hashes)), which % max(1, len(hashes))
                each = np.ones(len(which), np.int64)
                if before or goes_on:
                    words = terms.words(first[which]).cast(pa.binary()).to_pylist()
                    each = np.array([r != rows[0] or w not in before for r, w in zip(row.tolist(), words, strict=True)], dtype=np.int64)
                    before = before | {w for r, w in zip(row.tolist(), words, strict=True) if r == rows[-1]} if goes_on else set()
                group = np.array([of[r] for r in rows])[np.searchsorted(rows, row)]
                if held.add(hashes[which], group, each, count):
                    yield from held.take()
        yield from held.take()

    return docs.mapInArrow(run, "lang STRING, source STRING, term STRING, docs BIGINT, count BIGINT")


_SHARED = "two terms share a 64-bit hash: change the bytes' numbers in rolling.py"


def _marks(terms: Terms, at: np.ndarray) -> np.ndarray:
    """A second hash, of a term's length and its first and last eight bytes."""
    padded = np.concatenate([np.zeros(8, np.uint8), terms.data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(padded) - 7, "<u8", padded.tobytes(), strides=(1,))
    start, length = terms.start[at], terms.length[at]
    short = np.minimum(length, 8).astype(np.uint64) * np.uint64(8)
    head = np.where(short == 64, eight[start + 8], eight[start + 8] & ((np.uint64(1) << (short & np.uint64(63))) - np.uint64(1)))
    tail = np.where(short == 64, eight[start + length], 0)
    return mix(head) ^ mix(tail + length.astype(np.uint64) * ODD)


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(lang, term, total, by) of the terms in at least ``min_docs`` documents (lang, source, text) of their language; ``by`` has the
    (source, count) of the sources that hold it."""
    above = None
    for length in levels:
        sums = _prefixes(docs, length, above).repartition("key").groupBy("key").agg(F.sum("n").alias("n"))
        above = length, Sieve(sums.filter(F.col("n") >= min_docs))
    # tasks have added up already; one exchange by term serves both sums
    counts = _whole_terms(docs, *above).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("count"))
    by = F.collect_list(F.struct("source", "count")).alias("by")
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"), by)
    return terms.filter(F.col("docs") >= min_docs).drop("docs")


def _met(kept: DataFrame) -> DataFrame:
    """(lang, a, b, i, j, n): how many terms occur i times in source a and j times in source b, a before b."""
    names = ["lang", "a", "b", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            flat = lists.flatten()
            sources = flat.field(0).dictionary_encode()
            langs = batch.column(0).dictionary_encode()
            order = np.argsort(np.array(sources.dictionary.cast(pa.binary()).to_pylist(), dtype=object), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            source, count = rank[sources.indices.to_numpy()], flat.field(1).to_numpy()
            term = np.repeat(np.arange(len(size)), size)
            ends = np.cumsum(size)
            reach = size[term]  # each entry meets all entries of its term
            cuts = np.searchsorted(np.cumsum(reach), np.arange(PAIRS, reach.sum() + PAIRS, PAIRS))
            begin = 0
            for end in [*cuts.tolist(), len(reach)]:
                if end <= begin:
                    continue
                ones = np.repeat(np.arange(begin, end), reach[begin:end])
                upto = np.cumsum(reach[begin:end])
                twos = np.arange(upto[-1]) - np.repeat(upto - ends[term[begin:end]], reach[begin:end])
                up = source[ones] < source[twos]
                ones, twos = ones[up], twos[up]
                frame = pd.DataFrame({"lang": langs.indices.to_numpy()[term[ones]], "a": source[ones], "b": source[twos], "i": count[ones], "j": count[twos]})
                met = frame.groupby(names, sort=False).size().reset_index(name="n")
                name = [sources.dictionary.take(pa.array(order[met[c]])) for c in ("a", "b")]
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(met["lang"].to_numpy())), *name, *(pa.array(met[c].to_numpy(np.int64)) for c in ("i", "j", "n"))], names=[*names, "n"]
                )
                begin = end

    pairs = kept.filter(F.size("by") > 1).select("lang", "by").mapInArrow(run, "lang STRING, a STRING, b STRING, i BIGINT, j BIGINT, n BIGINT")
    return pairs.groupBy(*names).agg(F.sum("n").alias("n"))


def _share(count: Column, size: Column, kept: Column) -> Column:
    """p of a count: 0 where nothing is kept, as then nothing is summed."""
    whole = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    small = count < F.lit((1 << 63) // SCALE - 1)  # the product is a BIGINT
    share = F.when(small, F.call_function("div", (count + 1) * F.lit(SCALE), size + kept)).otherwise(F.call_function("div", whole, (size + kept).cast("decimal(20,0)")))
    return F.when(kept > 0, 1 + share).otherwise(0)


def _apart(p: Column, q: Column) -> Column:
    return F.when(q > 0, F.call_function("div", (p - q) * (p - q), q)).otherwise(0)


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` sums f against each other source of the language, part ``term`` has the
    ``top`` terms that are more frequent in the source than in the language, by f."""
    text = {n: F.coalesce(col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))}
    rows = docs.select(*text.values())
    kept = stored(kept_terms(rows, min_docs), "terms")
    cells = kept.select("lang", "term", "total", F.explode("by").alias("at")).select("lang", "term", "total", "at.source", "at.count")
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("whole"))
    of_source = cells.groupBy("lang", "source").agg(F.sum("count").alias("size"))
    groups = rows.select("lang", "source").distinct().join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = stored(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "kept", "whole")]), "sources")

    # terms in both sources; those that one of them lacks follow from its own counts
    no = F.lit(0).cast("bigint")
    one, two = (groups.select("lang", F.col("source").alias(s), F.col("size").alias(f"size_{s}"), *k) for s, k in (("a", ["kept"]), ("b", [])))
    with_sizes = _met(kept).join(one, ["lang", "a"]).join(two, ["lang", "b"])
    pa_, qa = (_share(c, F.col("size_a"), F.col("kept")) for c in (F.col("i"), no))
    pb, qb = (_share(c, F.col("size_b"), F.col("kept")) for c in (F.col("j"), no))
    with_sizes = with_sizes.select("lang", "a", "b", "n", pa_.alias("pa"), qa.alias("qa"), pb.alias("pb"), qb.alias("qb"))

    def beyond(p: str, p0: str, q: str, q0: str) -> Column:
        p, p0, q, q0 = (F.col(x) for x in (p, p0, q, q0))
        return F.col("n") * (_apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0))

    both = F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item"), beyond("pa", "qa", "pb", "qb").alias("value")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item"), beyond("pb", "qb", "pa", "qa").alias("value")),
    )
    shared = with_sizes.select("lang", F.explode(both).alias("x")).select("lang", "x.*")
    levels = cells.groupBy("lang", "source", "count").agg(F.count(F.lit(1)).alias("n"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("size").alias("size_other"))
    alone = levels.join(groups, ["lang", "source"]).join(others, "lang").filter("source != other")
    p, p0, q0 = _share(F.col("count"), F.col("size"), F.col("kept")), _share(no, F.col("size"), F.col("kept")), _share(no, F.col("size_other"), F.col("kept"))
    alone = alone.select("lang", "source", "other", "n", p.alias("p"), p0.alias("p0"), q0.alias("q0"))
    alone = alone.select(
        "lang", F.explode(F.array(
            F.struct("source", F.col("other").alias("item"), (F.col("n") * (_apart(F.col("p"), F.col("q0")) - _apart(F.col("p0"), F.col("q0")))).alias("value")),
            F.struct(F.col("other").alias("source"), F.col("source").alias("item"), (F.col("n") * (_apart(F.col("q0"), F.col("p")) - _apart(F.col("q0"), F.col("p0")))).alias("value")),
        )).alias("x")).select("lang", "x.*")
    empty = groups.join(others, "lang").filter("source != other").select(
        "lang", "source", F.col("other").alias("item"), (F.col("kept") * _apart(_share(no, F.col("size"), F.col("kept")), _share(no, F.col("size_other"), F.col("kept")))).alias("value")
    )
    exact = [x.withColumn("value", F.col("value").cast("decimal(38,0)")) for x in (shared, alone, empty)]
    pairs = exact[0].unionByName(exact[1]).unionByName(exact[2]).groupBy("lang", "source", "item").agg(F.sum("value").cast("bigint").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    ranked = cells.join(groups, ["lang", "source"])
    p, q = _share(F.col("count"), F.col("size"), F.col("kept")), _share(F.col("total"), F.col("whole"), F.col("kept"))
    ranked = ranked.select("lang", "source", "term", p.alias("p"), q.alias("q")).filter("p > q")
    terms = ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = terms.withColumn("rank", place).filter(F.col("rank") <= top)  # each task keeps its first ones before the shuffle
    return pairs.withColumn("rank", place).unionByName(best)

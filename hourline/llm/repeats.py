"""Repeated passages: every byte covered by a ``WINDOW``-byte string that also starts elsewhere goes.

Prefix-free parsing, spread over tasks. The text is cut by rolling-hash triggers: a place triggers if its
``GRAM`` bytes have the least hash in some window of ``WINDOW`` bytes (the first of equal ones), so every
window has a trigger of its own and equal windows have the same one. A phrase is what stands around a
trigger: the windows of a trigger that start between ``CELL`` c and ``CELL`` (c + 1) bytes before it share a
core, the bytes that are in all of them. Cores, known by hash, make the dictionary. One that occurs once rules
out all its windows; where all occurrences also share the bytes around it, all its windows are repeated. Both
need counts that combine on the map side, and settle nearly all of the text.

What is left are cores whose surroundings differ: the ends of repeated passages. There the two suffix
orders decide. The dictionary order sorts the bytes before a core backwards, so that occurrences with a common
suffix of any length stand side by side; the parse order sorts the bytes behind it. For each suffix length the
occurrences of a suffix, in the parse order, are the corpus order of the windows that begin there, and a window
is repeated if it agrees with a neighbour in that order to its end: common lengths are least values over the
neighbours' ones.

A core's group is compared in one task if it has at most ``GROUP`` different surroundings. A larger one is cut:
its windows are halved by where they begin, each half has a longer core, and the halves are counted
and sorted anew, until they are small or a core is a whole window. So no group is unbounded, no matter how many
documents share a passage, and none is left out.

Equal texts are one text: from 400 bytes on, each copy's bytes all occur in the other. What is broadcast are
filters of fixed size. A core is known by 64 bits, and the bytes next to it are compared with it, so that a window
is never taken for another unless hash and neighbourhood collide at once.

``cut_repeats`` gives the removed runs and the bytes that are left; ``digests`` and ``kept_text`` are columns made from them.

Defined results: a null text counts as empty. Repeated rows are copies of each other. Texts under ``WINDOW`` bytes
stay whole. An empty table gives no rows. A long text goes through in pieces that overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourline.llm.bit_filter import BitFilter, Sieve, held, place
from hourline.llm.frames import col, stored, utf8, wide_rows
from hourline.llm.rolling import ODD, Rolling, mix

WINDOW, GRAM, CELL = 400, 12, 128
#: Different surroundings of a core that are compared in one task, and rows that a task compares at once.
GROUP, ROWS = 4096, 8192
#: Bytes that are parsed at once.
PIECE = 1 << 17
_PLACE_BITS = np.uint64(24)
#: A text, by two hashes, the place of a core in it, and the windows (by bytes before the core) that are asked for.
_OCCURRENCE = ("t1", "t2", "at", "lo", "hi")
_SPANS = "ARRAY<STRUCT<begin: BIGINT, end: BIGINT>>"


# --- parsing -----------------------------------------------------------------------------------


def _pieces(texts: Iterable[bytes], window: int) -> Iterator[list[tuple[int, bytes, int, int, int]]]:
    """Lists of (row, bytes, place of the bytes in the text, first and last + 1 window start): whole texts, and longer ones in
    pieces that show what their windows' cores may reach on either side."""
    held, size, margin = [], 0, 2 * window
    for row, text in enumerate(texts):
        for begin in range(0, max(1, len(text) - window + 1), PIECE):
            low = max(0, begin - margin)
            part = text[low : begin + PIECE + margin]
            if held and size + len(part) > PIECE:
                yield held
                held, size = [], 0
            last = min(begin + PIECE, len(text) - window + 1)
            if last > begin:
                held.append((row, part, low, begin - low, last - low))
                size += len(part)
    if held:
        yield held


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each place on."""
    out, have = values, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def _ranges(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - begins
    upto = np.cumsum(sizes)
    return np.arange(upto[-1]) + np.repeat(begins - (upto - sizes), sizes)


def parse(piece: list[tuple[int, bytes, int, int, int]], window: int, cell: int) -> dict[str, np.ndarray]:
    """The cores of the windows of some texts: ``key`` of the core, ``whole`` of what stands around it as well, ``row``, ``at`` (its place
    in the text) and the windows that it owns there, ``lo`` to ``hi`` bytes before ``at``."""
    parts = [p[1] for p in piece]
    sizes = np.array([len(p) for p in parts])
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    rolling = Rolling(data)
    grams = rolling.grams(GRAM)
    grams = grams >> _PLACE_BITS << _PLACE_BITS | np.arange(len(grams), dtype=np.uint64)
    first = _least(grams, window - GRAM + 1)  # by window start
    starts = _ranges(begins + [p[3] for p in piece], begins + [p[4] for p in piece])
    trigger = (first[starts] & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    number = (trigger - starts) // cell
    new = np.append(True, (np.diff(trigger) != 0) | (np.diff(number) != 0) | (np.diff(starts) != 1))
    run = np.flatnonzero(new)
    last = np.append(run[1:], len(new)) - 1
    core = trigger[run] - number[run] * cell
    part = np.searchsorted(begins, starts[run], side="right") - 1
    low, high = begins[part], begins[part] + sizes[part]
    length = window - cell + 1
    left, right = np.minimum(cell - 1, core - low), np.minimum(cell - 1, high - core - length)
    key = mix(rolling.hashes(core, np.full(len(core), length)) + number[run].astype(np.uint64) * ODD)
    whole = mix(rolling.hashes(core - left, left + length + right) + (left * cell + right).astype(np.uint64) * ODD) ^ key
    row, offset = np.array([p[0] for p in piece]), np.array([p[2] for p in piece])
    return {"key": key.view(np.int64), "whole": whole.view(np.int64), "row": row[part], "at": core - low + offset[part], "lo": core - starts[last], "hi": core - starts[run]}


class Texts:
    """Different texts (t1, t2, bytes): rows of which some are copies, and one row for each text that has copies. A filter tells
    the rows of texts that have copies, a few others with them, which are then among the latter."""

    def __init__(self, rows: DataFrame, several: BitFilter, one: DataFrame) -> None:
        columns = ("t1", "t2", "bytes", place(F.col("t1")).alias("place"))
        self._rows, self._one, self._several = rows.select(*columns), one.select(*columns), several.words

    def map(self, make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, wanted: BitFilter | None = None) -> DataFrame:
        """What ``make`` gives for the batches of texts; only those that may be ``wanted``, by t1."""
        asked = wanted.words if wanted is not None else None

        def over(several):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    pa.default_memory_pool().release_unused()  # what earlier batches took
                    places = batch.column(3).to_numpy()
                    good = np.ones(len(places), dtype=bool) if several is None else ~held(several, places)
                    if asked is not None:
                        good &= held(asked, places)
                    if good.any():
                        yield from make(batch if good.all() else batch.filter(pa.array(good)))

            return run

        return self._rows.mapInArrow(over(self._several), schema).unionByName(self._one.mapInArrow(over(None), schema))

    def asked(self, wanted: BitFilter) -> DataFrame:
        return self.map(lambda batch: iter([batch.select([0, 1, 2])]), "t1 BIGINT, t2 BIGINT, bytes BINARY", wanted)


def _cores(texts: Texts, window: int, cell: int, sieve: Sieve | None = None) -> DataFrame:
    """(key, whole, t1, t2, at, lo, hi) of texts; only those whose key may be in the ``sieve``."""
    names = ["key", "whole", *_OCCURRENCE]

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(utf8(batch.column(2)), window):
            found = parse(piece, window, cell)
            if sieve is not None:
                stay = sieve.stay(found["key"].view(np.uint64))
                found = {n: x[stay] for n, x in found.items()}
            rows = pa.array(found["row"])
            yield pa.RecordBatch.from_arrays([
                *(pa.array(found[n]) for n in ("key", "whole")), *(batch.column(i).take(rows) for i in (0, 1)),
                *(pa.array(found[n], pa.int64()) for n in ("at", "lo", "hi"))], names=names)

    return texts.map(make, ", ".join(f"{n} BIGINT" for n in names))


# --- counting ----------------------------------------------------------------------------------


def _occ() -> F.Column:
    """An occurrence of a core as one number."""
    return F.xxhash64("t1", "t2", "at").alias("occ")


def _kinds(cores: DataFrame) -> DataFrame:
    """(key, alike) of cores that occur at two places at least; ``alike`` if what stands around them is always the same."""
    sums = cores.select("key", "whole", _occ()).groupBy("key").agg(*[f(c).alias(f"{n}_{c}") for c in ("occ", "whole") for n, f in (("a", F.min), ("b", F.max))])
    return sums.filter("a_occ != b_occ").select("key", (F.col("a_whole") == F.col("b_whole")).alias("alike"))


def _windows(rows: DataFrame) -> DataFrame:
    """(t1, t2, first, last): starts of repeated windows."""
    return rows.select("t1", "t2", (F.col("at") - F.col("hi")).alias("first"), (F.col("at") - F.col("lo")).alias("last"))


def _members(mixed: DataFrame, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(windows that occur with the same surroundings elsewhere, one occurrence for each surroundings of a core). The latter have
    ``twice`` if there are others, and the ``size`` of their core's group."""
    kept = [F.first(c).alias(c) for c in extra]
    once = mixed.groupBy("key", "whole", "t1", "t2", "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *kept)  # pieces and repeated rows
    once = stored(once.withColumn("occ", _occ()), "occurrences")
    same = once.groupBy("key", "whole").agg(F.min("occ").alias("occ"), F.max("occ").alias("b_occ"))
    same = same.select("key", "whole", "occ", (F.col("occ") != F.col("b_occ")).alias("twice"))
    again = once.join(same.filter("twice").select("key", "whole"), ["key", "whole"])
    sizes = same.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    return _windows(again), once.join(same, ["key", "whole", "occ"]).drop("occ").join(sizes, "key")


# --- the two orders -----------------------------------------------------------------------------


def _sorted(group: np.ndarray, texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by group and bytes, common length of each one with the next; -1 between groups)."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    cells = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), dtype=np.uint8).reshape(len(texts), width)
    heads = group.astype(">u4").view(np.uint8).reshape(-1, 4)
    keys = np.concatenate([heads, cells, size.astype(np.uint8)[:, None]], axis=1)
    order = np.argsort(np.ascontiguousarray(keys).view(f"S{width + 5}")[:, 0], kind="stable")
    cells, size, group = cells[order], size[order], group[order]
    unlike = cells[1:] != cells[:-1]
    common = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width) if width else np.zeros(len(unlike), np.int64)
    common = np.minimum(common, np.minimum(size[1:], size[:-1]))
    return order, np.where(group[1:] == group[:-1], common, -1)


class _LeastBetween:
    """The least value of any stretch, from the least ones of stretches of 1, 2, 4 ... places."""

    def __init__(self, values: np.ndarray) -> None:
        self._levels = [values]
        while len(self._levels[-1]) > 1 << (len(self._levels) - 1):
            step = 1 << (len(self._levels) - 1)
            self._levels.append(np.minimum(self._levels[-1][:-step], self._levels[-1][step:]))
        most = max(map(len, self._levels))
        self._table = np.stack([np.append(x, np.full(most - len(x), -1)) for x in self._levels])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        level = np.frexp(end - begin)[1] - 1
        return np.minimum(self._table[level, begin], self._table[level, end - (1 << level)])


def repeated(group: np.ndarray, left: list[bytes], right: list[bytes], lo: np.ndarray, hi: np.ndarray, cell: int) -> np.ndarray:
    """(member, window) -> whether it agrees with a window of another member of the group. ``left`` has the bytes before the core, nearest
    first; window j takes j of them, and cell - 1 - j of those in ``right``."""
    n = len(group)
    found = np.zeros((n, cell), dtype=bool)
    suffixes, suffix_common = _sorted(group, left, cell - 1)  # dictionary order
    parse_order, parse_common = _sorted(group, right, cell - 1)
    place = np.empty(n, np.int64)
    place[parse_order] = np.arange(n)
    least = _LeastBetween(parse_common) if n > 1 else None
    kind = np.empty(n, np.int64)
    for j in range(cell if n > 1 else 0):
        here = np.flatnonzero((lo <= j) & (j <= hi))
        if len(here) < 2:
            continue
        kind[suffixes] = np.append(0, np.cumsum(suffix_common < j))
        corpus = here[np.argsort(kind[here] * n + place[here])]
        one, two = corpus[:-1], corpus[1:]
        beside = kind[one] == kind[two]
        one, two = one[beside], two[beside]
        agree = least(place[one], place[two]) >= cell - 1 - j
        found[one[agree], j] = found[two[agree], j] = True
    return found


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of ROWS rows or more, cut between keys; the first column is the key, and rows are sorted by it."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        if held.num_rows >= ROWS:
            keys = held.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(keys))
            if len(cuts):
                cut = int(cuts[-1]) + 1
                yield held.slice(0, cut)
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _compare(members: DataFrame, cell: int) -> DataFrame:
    """(t1, t2, first, last) of repeated windows of members (see ``_members``) with their bytes ``left`` and ``right``."""
    dealt = members.select("key", *_OCCURRENCE, "twice", "left", "right").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            key, at, lo, hi = (table.column(n).to_numpy() for n in ("key", "at", "lo", "hi"))
            group = np.append(0, np.cumsum(np.diff(key) != 0))
            left, right = (table.column(n).to_pylist() for n in ("left", "right"))
            found = repeated(group, left, right, lo, hi, cell)
            found[table.column("twice").to_numpy(zero_copy_only=False)] = False  # known already
            edges = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, begin = np.nonzero(edges == 1)
            end = np.nonzero(edges == -1)[1] - 1
            rows = pa.array(row)
            columns = [*(table.column(n).take(rows) for n in ("t1", "t2")), pa.array(at[row] - end), pa.array(at[row] - begin)]
            yield from pa.table(columns, names=["t1", "t2", "first", "last"]).combine_chunks().to_batches()

    return dealt.mapInArrow(run, "t1 BIGINT, t2 BIGINT, first BIGINT, last BIGINT")


def _halves(members: DataFrame, cell: int) -> DataFrame:
    """The members of large groups, each with the windows of either half of its cell: their core is longer by half a cell."""
    half = cell // 2

    def cut(side: str, place: int, length: int | None = None) -> F.Column:
        return F.substring(side, place + 1, cell if length is None else length)

    more = F.struct(
        F.xxhash64("key", F.lit(1), cut("left", 0, half)).alias("key"), (F.col("at") - half).alias("at"), F.greatest(F.col("lo") - half, F.lit(0)).alias("lo"),
        (F.col("hi") - half).alias("hi"), cut("left", half).alias("left"), cut("right", 0, half - 1).alias("right"),
    )
    less = F.struct(
        F.xxhash64("key", F.lit(2), cut("right", 0, half)).alias("key"), F.col("at").alias("at"), F.col("lo").cast("bigint").alias("lo"),
        F.least(F.col("hi"), F.lit(half - 1)).alias("hi"), cut("left", 0, half - 1).alias("left"), cut("right", half).alias("right"),
    )
    either = F.array_compact(F.array(F.when(F.col("hi") >= half, more), F.when(F.col("lo") < half, less)))
    rows = members.select("t1", "t2", F.explode(either).alias("x")).select("t1", "t2", "x.*")
    return rows.withColumn("whole", F.xxhash64("key", "left", "right"))


# --- whole texts --------------------------------------------------------------------------------


def _with_bytes(members: DataFrame, texts: Texts, window: int, cell: int) -> DataFrame:
    """Members with the bytes around their core."""
    own = ["key", "whole", "at", "lo", "hi", "twice", "size"]
    asked = members.groupBy("t1", "t2").agg(F.collect_list(F.struct(*own)).alias("asked"))  # of one text each
    met = texts.asked(BitFilter(members.select("t1"))).join(asked, ["t1", "t2"]).select("t1", "t2", "bytes", "asked")
    length = window - cell + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for row in range(batch.num_rows):
                text, lists = batch.column(2)[row].as_py(), batch.column(3).slice(row, 1).flatten()
                at = lists.field(own.index("at")).to_numpy().tolist()
                left = [text[max(0, a - cell + 1) : a][::-1] for a in at]
                right = [text[a + length : a + length + cell - 1] for a in at]
                t = [pa.repeat(batch.column(i)[row], len(at)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*t, *lists.flatten(), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["t1", "t2", *own, "left", "right"])

    schema = "t1 BIGINT, t2 BIGINT, key BIGINT, whole BIGINT, at BIGINT, lo BIGINT, hi BIGINT, twice BOOLEAN, size BIGINT, left BINARY, right BINARY"
    return met.mapInArrow(run, schema)


def repeated_windows(texts: Texts, window: int = WINDOW, cell: int = CELL, group: int = GROUP) -> DataFrame:
    """(t1, t2, first, last): the starts of windows of the texts that occur at another place as well."""
    kinds = stored(_kinds(_cores(texts, window, cell)), "kinds")
    found = stored(_cores(texts, window, cell, Sieve(kinds)).join(kinds, "key"), "cores")
    again, members = _members(found.filter("NOT alike"))
    out = [_windows(found.filter("alike")), again]
    members = stored(_with_bytes(stored(members, "members"), texts, window, cell), "surroundings")
    while True:
        out.append(_compare(members.filter(F.col("size") <= group), cell))
        large = members.filter(F.col("size") > group)
        if not large.head(1):
            return reduce(DataFrame.unionByName, out)
        rows, cell = stored(_halves(large, cell), "halves"), cell // 2
        found = stored(rows.join(_kinds(rows), "key"), "cores")
        again, members = _members(found.filter("NOT alike"), ("left", "right"))
        members = stored(members, "members")
        out += [_windows(found.filter("alike")), again]


def _cut(rows: DataFrame, window: int) -> DataFrame:
    """(id, n_bytes, spans, kept) of rows (id, bytes) with the repeated ``windows`` (first, last) of their text, if any, and ``gone``
    where the whole text has a copy."""
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL(f"n_bytes BIGINT, spans {_SPANS}, kept BINARY")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pa.default_memory_pool().release_unused()
            sizes, begins, ends, counts, kept = [], [], [], [0], []
            for row in range(batch.num_rows):
                text, lists = batch.column(1)[row].as_py(), batch.column(2).slice(row, 1).flatten()
                first, last = (lists.field(i).to_numpy() for i in (0, 1))
                if batch.column(3)[row].as_py():
                    first, last = np.array([0]), np.array([len(text) - window])
                depth = np.zeros(len(text) + 1, dtype=np.int64)
                np.add.at(depth, first, 1)
                np.add.at(depth, last + window, -1)
                gone = np.cumsum(depth)[:-1] > 0
                edges = np.diff(gone.astype(np.int8), prepend=0, append=0)
                sizes.append(len(text))
                begins.append(np.flatnonzero(edges == 1))
                ends.append(np.flatnonzero(edges == -1))
                counts.append(len(begins[-1]))
                kept.append(np.frombuffer(text, dtype=np.uint8)[~gone].tobytes())
            runs = pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (begins, ends)], ["begin", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), spans, pa.array(kept, pa.binary())], names=schema.names)

    return rows.select("id", "bytes", "windows", "gone").mapInArrow(run, schema)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cell: int = CELL, group: int = GROUP) -> DataFrame:
    """(id, n_bytes, spans, kept) for each row of ``docs``: the removed runs, as places of bytes from ``begin`` up to ``end``, and the bytes that
    are left."""
    if not 2 * GRAM <= window or cell & (cell - 1) or not 1 < cell <= min(window // 2, 128):
        raise ValueError("cell must be a power of two up to 128 and half a window")
    content = F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary")
    whole = F.sha2(content, 256)
    rows = docs.select(col(id_col).alias("id"), content.alias("bytes"), whole.alias("sha"))
    rows = rows.select("id", "bytes", F.xxhash64(F.substring("sha", 1, 32)).alias("t1"), F.xxhash64(F.substring("sha", 33, 32)).alias("t2"))
    with wide_rows(docs.sparkSession):
        short, long = rows.filter(F.length("bytes") < window), rows.filter(F.length("bytes") >= window).select("id", "t1", "t2", "bytes")
        copies = stored(long.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("n > 1"), "copies")
        several = BitFilter(copies.select("t1"))
        one = several.rows(long, F.col("t1")).join(copies, ["t1", "t2"], "left").filter(F.col("n").isNull() | F.col("id").eqNullSafe(F.col("first")))
        texts = Texts(long, several, one)

        windows = repeated_windows(texts, window, cell, group)
        of_text = stored(windows.groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "last")).alias("windows")), "windows")
        alone = of_text.join(copies, ["t1", "t2"], "left_anti").withColumn("gone", F.lit(False))  # of a text with copies nothing stays
        marks = alone.unionByName(copies.select("t1", "t2", F.lit(True).alias("gone")), allowMissingColumns=True)
        asked = BitFilter(marks.select("t1"))
        cut = _cut(asked.rows(long, F.col("t1")).join(marks, ["t1", "t2"], "left"), window)
        uncut = short.select("id", "bytes").unionByName(asked.rows(long, F.col("t1"), hit=False).select("id", "bytes"))
        uncut = uncut.select("id", F.length("bytes").cast("bigint").alias("n_bytes"), F.array().cast(_SPANS).alias("spans"), F.col("bytes").alias("kept"))
        done = stored(cut.unionByName(uncut), "kept")
    return done.select(F.col("id").alias(id_col), "n_bytes", "spans", "kept")


def digests() -> list[F.Column]:
    """n_bytes, n_removed, n_spans, kept_sha256 (the hash of the bytes that are left) from what ``cut_repeats`` gives."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return [F.col("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]


def kept_text() -> F.Column:
    """The bytes that are left as a text. A run may begin or end inside a character: what is left of it becomes U+FFFD."""
    return F.make_valid_utf8(F.col("kept").cast("string"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cell: int = CELL, group: int = GROUP) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs``."""
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    return cut_repeats(texts, "id", "text", window, cell, group).select(F.col("id").alias(id_col), *digests())

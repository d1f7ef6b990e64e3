"""Token counts by a compiled finite-state tokenizer.

A deterministic transducer reads characters and annotates each transition with the number of tokens
it adds (or, where a longer token replaces shorter ones, takes back), so that the sum over a text is
the text's token count. A state holds what a further character can change: for every place where a
vocabulary piece could still begin, the token before it and the count there, less the count so far.
Whether a piece may follow a token is asked of ``automaton.TokenAutomaton``. Transitions are compiled
when first met and kept up to a bound; the full machine is not needed for any corpus.

Chunks of a text compose without being read in order. No piece goes on past a border: a word mark
behind another character, or a character that only stands alone. Between its first and last border
the count of a chunk is fixed, so its state map is (text before the first border, count, text after
the last border), and two neighbouring maps make one by reading the text that meets between them.
``count_tokens`` cuts long texts into chunks, maps them in any task and joins the maps by document.

The model file is a SentencePiece BPE model with byte fallback and identity normalisation.
Characters outside the vocabulary count one token for each byte.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens. Rows are never merged: a
repeated row or a null id gives a row of its own. Input columns beside id and text are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourline.llm.automaton import TokenAutomaton
from hourline.llm.frames import col
from hourline.llm.words import Kept

MARK = "▁"  # stands for a space
#: Characters of a chunk. Longer texts are counted by several tasks.
CHUNK = 1 << 16
KEPT_UNITS = 250_000
KEPT_TRANSITIONS = 1_000_000


class CountTransducer:
    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        ids = {model.id_to_piece(i): i for i in normal}
        if any(MARK in p.lstrip(MARK) for p in ids) or any(model.encode(x, out_type=str)[0] != MARK + x for x in "ab"):
            raise ValueError("this kind of model isn't supported")
        longer = sorted((p for p in ids if len(p) > 1), key=len)
        rank = {ids[p]: -model.get_score(ids[p]) for p in longer}  # equal scores: the leftmost merges first
        texts = {i: p for p, i in ids.items()}

        def rank_of(left: int, right: int) -> float | None:
            return rank.get(ids.get(texts[left] + texts[right], -1))

        rules = ((rank[ids[p]], ids[p[:n]], ids[p[n:]], ids[p]) for p in longer for n in range(1, len(p)) if p[:n] in ids and p[n:] in ids)
        self._automaton = TokenAutomaton(rules, rank_of)
        made = self._automaton.made
        alive = {p: i for p, i in ids.items() if len(p) == 1 or i in made}
        #: Every beginning of a piece: its id or -1, and whether a longer piece begins so.
        self._beginnings: dict[str, tuple[int, bool]] = {p: (i, False) for p, i in alive.items()}
        for p in alive:
            for n in range(1, len(p)):
                self._beginnings[p[:n]] = (alive.get(p[:n], -1), True)
        joined = {c for p in alive if len(p) > 1 for c in p}
        #: Characters that no longer piece holds: each is one token, or its bytes.
        self.alone = "".join(sorted(c for c in map(chr, range(128)) if c not in joined and c != " "))
        #: Ends of units: a word mark behind another character, and lone control characters.
        self._units = re.compile(f"{MARK}+[^{MARK}{re.escape(self.alone)}]*|[^{MARK}{re.escape(self.alone)}]+|[{re.escape(self.alone)}]")
        self._kept = Kept(self.count_unit, KEPT_UNITS)
        self._reset()

    def _reset(self) -> None:
        self._states: dict[tuple, int] = {}
        self._keys: list[tuple] = []
        self._moves: list[dict[str, tuple[int, int]]] = []
        self._start = self._state(("", ((0, -1, 0),)))

    def _state(self, key: tuple) -> int:
        number = self._states.setdefault(key, len(self._keys))
        if number == len(self._keys):
            self._keys.append(key)
            self._moves.append({})
        return number

    def _compile(self, state: int, c: str) -> tuple[int, int]:
        """The transition on ``c``: the state it leads to and the tokens it adds.

        A state is the text of the oldest place still open and, for each open place, how many of its
        characters have been read, the token before it, and the count there less the count so far.
        """
        text, places = self._keys[state]
        text += c
        token, delta, still = -1, 0, []
        for length, last, count in places:
            length += 1
            found = self._beginnings.get(text[len(text) - length :])
            if found is None:
                continue
            piece, longer = found
            if piece >= 0 and (last < 0 or self._automaton.step(last, piece)):
                token, delta = piece, count + 1
            if longer:
                still.append((length, last, count))
        if token < 0:  # not in the vocabulary: bytes, and nothing goes on past them
            return self._start, len(c.encode())
        still.append((0, token, delta))
        longest = still[0][0]
        key = (text[len(text) - longest :], tuple((n, last, count - delta) for n, last, count in still))
        return self._state(key), delta

    def count_unit(self, unit: str) -> int:
        """Tokens of a text without a border inside."""
        if len(self._states) > KEPT_TRANSITIONS // 4:
            self._reset()
        state, total, moves = self._start, 0, self._moves
        for c in unit:
            move = moves[state].get(c)
            if move is None:
                move = moves[state][c] = self._compile(state, c)
            state, delta = move
            total += delta
        return total

    def units(self, marked: str) -> list[str]:
        return self._units.findall(marked)

    def count(self, marked: str) -> int:
        """Tokens of a text whose spaces are word marks and which begins and ends at borders."""
        return sum(map(self._kept.__getitem__, self._units.findall(marked)))

    def chunk_map(self, chunk: str) -> tuple[str, int, str, bool]:
        """(head, count, tail, whether there is a border inside); without one head holds all."""
        units = self.units(chunk)
        if len(units) < 2:
            return chunk, 0, "", False
        return units[0], sum(map(self._kept.__getitem__, units[1:-1])), units[-1], True

    def compose(self, one: tuple[str, int, str, bool], two: tuple[str, int, str, bool]) -> tuple[str, int, str, bool]:
        """The map of two neighbouring chunks; associative."""
        (head, n, tail, cut), (head2, n2, tail2, cut2) = one, two
        between = (tail if cut else head) + head2
        joint = self.chunk_map(between)
        middle = (joint[1], joint[3])
        if not cut and not cut2:
            return joint
        if not cut:
            return (joint[0], self._kept[joint[2]] + joint[1] + n2, tail2, True) if middle[1] else (between, n2, tail2, True)
        if not cut2:
            return (head, n + self._kept[joint[0]] + joint[1], joint[2], True) if middle[1] else (head, n, between, True)
        return head, n + self.count(between) + n2, tail2, True


@lru_cache(maxsize=2)
def transducer(path: str) -> CountTransducer:
    """One machine for each worker and file."""
    return CountTransducer(path)


def marked(text: str) -> str:
    """The text as the model reads it: a word mark before it and for every space."""
    return (MARK + text).replace(" ", MARK) if text else ""


#: Texts over so many characters are dealt out chunk by chunk instead of counted in one task.
SPREAD = 1 << 20


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk: int = CHUNK, spread: int = SPREAD) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of ``docs``."""
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    here = _counted(rows.filter(F.length("text") <= spread), path, chunk)
    counts = here.unionByName(_spread(rows.filter(F.length("text") > spread), path, chunk))
    return counts.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _fold(machine: CountTransducer, maps: list[tuple[str, int, str, bool]]) -> int:
    """The count of a text from the maps of its chunks, joined two by two."""
    while len(maps) > 1:
        pairs = [machine.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
        maps = [*pairs, *maps[len(pairs) * 2 :]]
    return sum(machine.count(head) + n + machine.count(tail) for head, n, tail, _ in maps)


def _counted(rows: DataFrame, path: str, chunk: int) -> DataFrame:
    schema = T.StructType([rows.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            sizes, counts = [], []
            for value in batch.column(1):
                text = value.as_py()
                sizes.append(len(text.encode()))
                text = marked(text)
                maps = [machine.chunk_map(text[k : k + chunk]) for k in range(0, len(text), chunk)] if len(text) > chunk else []
                counts.append(_fold(machine, maps) if maps else machine.count(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _spread(rows: DataFrame, path: str, chunk: int) -> DataFrame:
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    starts = F.expr(f"sequence(0L, CAST(length(text) - 1 AS BIGINT) DIV {chunk})")
    chunks = numbered.withColumn("k", F.explode(starts)).select(
        "row", "id", "k", F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.concat(F.when(F.col("k") == 0, F.lit(MARK)).otherwise(F.lit("")), F.translate(F.substring(F.col("text"), (F.col("k") * chunk + 1).cast("int"), F.lit(chunk)), " ", MARK)).alias("chunk"),
    )
    kind = chunks.schema["id"].dataType
    fields = [T.StructField("row", T.LongType()), T.StructField("id", kind), T.StructField("k", T.LongType()), T.StructField("n_bytes", T.LongType())]
    schema = T.StructType([*fields, T.StructField("head", T.StringType()), T.StructField("n", T.LongType()), T.StructField("tail", T.StringType()), T.StructField("cut", T.BooleanType())])

    def to_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            maps = [machine.chunk_map(x.as_py()) for x in batch.column(4)]
            parts = [pa.array([m[i] for m in maps], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *parts], names=schema.names)

    maps = chunks.repartition("row", "k").mapInArrow(to_maps, schema)
    joined = maps.groupBy("row").agg(
        F.first("id").alias("id"), F.first("n_bytes").alias("n_bytes"), F.array_sort(F.collect_list(F.struct("k", "head", "n", "tail", "cut"))).alias("maps")
    ).select("id", "n_bytes", "maps")  # one text's maps: a few words for each chunk
    out = T.StructType([T.StructField("id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def to_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            counts = [_fold(machine, [(m["head"], m["n"], m["tail"], m["cut"]) for m in x.as_py()]) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(counts, pa.int64())], names=out.names)

    return joined.mapInArrow(to_counts, out)

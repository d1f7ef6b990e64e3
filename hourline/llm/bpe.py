"""BPE encoding and decoding with a tokenization automaton.

``encode`` turns whole texts into token ids by the paths of ``automaton.TokenAutomaton`` over
pre-split words; ``decode`` emits the labels of the arcs that the ids name. The vocabulary file is a
"tokenizers" JSON of kind BPE with an end-of-word mark, lower-casing and a byte alphabet; its path is
a parameter and it is read in the tasks.

Words recur, so each Python worker keeps the ids of the words it met last, up to a bound. A text is never held in more than one piece per step, and costs linear time.

Defined results: a null text counts as empty and has no ids; strings of special tokens inside a text
become their special id, as the library does by default; repeated rows, null ids and further columns
pass through unchanged.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from hourline.llm.automaton import Encoder, TokenAutomaton
from hourline.llm.frames import fresh, utf8, with_added
from hourline.llm.words import Kept, PreSplit

#: Words a worker keeps, and as many older ones.
KEPT_WORDS = 250_000
_END = "\0"  # stands for the end-of-word mark within symbol strings


class BpeTokenizer:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, mark = spec["model"], spec["model"]["end_of_word_suffix"]
        ids = {t.replace(mark, _END): i for t, i in model["vocab"].items()}
        merges = [[x.replace(mark, _END) for x in (m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        rules = [(rank, ids[a], ids[b], ids[a + b]) for rank, (a, b) in enumerate(merges)]
        ranks = {(left, right): rank for rank, left, right, _ in rules}
        automaton = TokenAutomaton(rules, lambda left, right: ranks.get((left, right)))
        if spec["decoder"] or not mark or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("this kind of vocabulary file isn't supported")
        self._split, self._encoder = PreSplit(Tokenizer.from_file(path)), Encoder(automaton, ids)
        self._ids = Kept(self._chunk_ids, KEPT_WORDS)  # chunks between ASCII white space
        self.special = {t["content"].encode(): np.array([t["id"]], dtype="<u4").tobytes() for t in spec["added_tokens"]}
        self._special = re.compile(b"(" + b"|".join(map(re.escape, self.special)) + b")")
        labels = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.labels = [labels.get(i, "") for i in range(max(labels) + 1)]

    def _chunk_ids(self, chunk: bytes) -> bytes:
        ids: list[int] = []
        for word in self._split(chunk):
            found = self._encoder.path(word + _END)
            if found is None:
                raise ValueError(f"no path spells {word!r}: the vocabulary lacks a byte")
            ids += found
        return pack("<%dI" % len(ids), *ids)

    def encode(self, text: bytes) -> bytes:
        """Ids of a UTF-8 text as little-endian 32-bit integers."""
        ids = self._ids.__getitem__
        if not self._special.search(text):
            return b"".join(map(ids, text.split()))
        parts = self._special.split(text)
        return b"".join(self.special[part] if part in self.special else b"".join(map(ids, part.split())) for part in parts)

    def decode(self, ids: bytes) -> str:
        """The arc labels with one space between, as the library decodes without a decoder."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> BpeTokenizer:
    """One automaton for each worker and file."""
    return BpeTokenizer(path)


def _added(df: DataFrame, source: str, field: T.StructField, make: Callable[[], Callable[[bytes], object]], arrow: pa.DataType) -> DataFrame:
    schema, at = with_added(df, [field]), df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            values = pa.array(map(each, utf8(batch.column(at))), arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=schema.names)

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All rows and columns, and behind them the ids as BINARY (little-endian, 4 bytes each)."""
    return _added(docs, text_col, T.StructField(fresh(docs, ids_col), T.BinaryType()), lambda: tokenizer(path).encode, pa.binary())


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All rows and columns, and behind them the text that the ids spell (null ids: empty)."""
    return _added(rows, ids_col, T.StructField(fresh(rows, text_col), T.StringType()), lambda: tokenizer(path).decode, pa.string())


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass over the texts."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([docs.schema[id_col], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            sizes, ids_hash, text_hash = [], [], []
            for text in utf8(batch.column(1)):
                ids = bpe.encode(text)
                sizes.append(len(ids) // 4)
                ids_hash.append(sha256(ids).hexdigest())
                text_hash.append(sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)

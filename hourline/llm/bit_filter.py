"""A filter of fixed size that keeps most rows out of a shuffle.

The filter has one bit for each of 2 ** BITS hash values, whatever the number of keys, so what is
collected and broadcast is bounded by 2 ** BITS / 8 bytes. It says no only for keys that aren't held; a
yes must be followed by a join. With more keys than bits it says yes to all, and the join does the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26


def _place(key: F.Column) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(BITS), key), 64 - BITS)


def place(key: F.Column) -> F.Column:
    """A key's bit in any filter."""
    return _place(key)


def held(words: Broadcast, places: np.ndarray) -> np.ndarray:
    """Which of the places are held."""
    return (words.value[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class BitFilter:
    def __init__(self, keys: DataFrame) -> None:
        """``keys`` has one column."""
        key = F.col(keys.columns[0])
        bit = F.expr("shiftleft(1L, CAST(x & 63 AS INT))")
        words = keys.select(_place(key).alias("x")).select(F.shiftrightunsigned("x", 6).alias("word"), bit.alias("bit"))
        table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2 ** (BITS - 6) rows at most
        held = np.zeros(1 << (BITS - 6), dtype=np.uint64)
        held[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
        self._words = keys.sparkSession.sparkContext.broadcast(held)

    @property
    def words(self) -> Broadcast:
        """The bits, for tasks that test places (see ``place``) themselves."""
        return self._words

    def rows(self, df: DataFrame, key: F.Column, hit: bool = True) -> DataFrame:
        """The rows of ``df`` whose key may be held, or those whose key isn't."""
        words = self._words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pa.default_memory_pool().release_unused()  # what earlier batches took
                found = held(words, batch.column(batch.num_columns - 1).to_numpy())
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(found == hit))

        return df.select("*", _place(key).alias("__place")).mapInArrow(run, df.schema)


class Sieve:
    """The same for keys that are 64-bit hashes themselves, which tasks test by their first bits."""

    def __init__(self, keys: DataFrame) -> None:
        """``keys`` has a BIGINT ``key``."""
        place = F.shiftrightunsigned("key", 64 - BITS).alias("place")
        bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))").alias("bit")
        words = keys.select(place).select(F.shiftrightunsigned("place", 6).alias("word"), bit)
        table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2 ** (BITS - 6) rows at most
        held = np.zeros(1 << (BITS - 6), dtype=np.uint64)
        held[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
        self.bits: Broadcast = keys.sparkSession.sparkContext.broadcast(held)

    def stay(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> np.uint64(64 - BITS)
        return (self.bits.value[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)

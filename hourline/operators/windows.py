"""Sliding windows over consecutive rows, batches, frames and first rows."""

from __future__ import annotations

from functools import reduce
from math import exp
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourline.operators.segments import CHUNK, HALO, RN, SIZE, chunk_window, index_rows, with_chunks

KEYS = ("series",)


def lookback(df, columns, length: int, keys=KEYS, ts="ts") -> DataFrame:
    """Each row with the ``columns`` of the ``length`` rows before it (``window``, oldest first).

    The first ``length`` rows of a series have no full window and drop out. Windows are cut in
    chunks of rows with ``length`` copied rows in front, so a long series spreads over many tasks.
    """
    return window_target(df, columns, None, length, keys=keys, ts=ts, to_end=True).drop("target", SIZE)


def window_target(
    df, columns, target, length: int, delay=0, min_index=0, max_index=None, step=1,
    keys=KEYS, ts="ts", to_end=False,
) -> DataFrame:
    """Look-back windows with the target ``delay`` rows ahead.

    Rows from ``min_index + length`` up to but not including ``max_index`` (default: series size -
    delay - 1) are kept; ``step`` thins the window and must divide ``length``.
    """
    if length % step:
        raise ValueError("step must divide length")
    chunks = with_chunks(index_rows(df, keys, ts), length, delay)
    ordered = chunk_window(keys)
    fields = F.struct(*columns)
    window = F.collect_list(fields).over(ordered.rowsBetween(-length, -1))
    ahead = F.lead(target, delay).over(ordered) if target else F.lit(None)
    out = chunks.withColumns({"window": window, "target": ahead})
    stop = F.col(SIZE) if to_end else F.col(SIZE) - delay - 1 if max_index is None else F.lit(max_index)
    out = out.filter(~F.col(HALO) & (F.col(RN) >= min_index + length) & (F.col(RN) < stop))
    if step > 1:
        out = out.withColumn("window", F.filter("window", lambda _, i: i % step == 0))
    return out.drop(CHUNK, HALO)


def row_lags(df, count: int, keys=KEYS, ts="ts", value="value") -> DataFrame:
    """Each row with the values 1..count rows before it as plain columns ``lag_1`` .. ``lag_<count>``.

    The flat form of ``lookback`` for one column; the first ``count`` rows of a series drop out.
    """
    chunks = with_chunks(index_rows(df.select(*keys, ts, value), keys, ts), count)
    ordered = chunk_window(keys)
    lagged = chunks.withColumns({f"lag_{k}": F.lag(value, k).over(ordered) for k in range(1, count + 1)})
    return lagged.filter(~F.col(HALO) & (F.col(RN) >= count)).drop(CHUNK, HALO, RN, SIZE)


def batches(windows, size: int, length: int, delay=0, min_index=0, max_index=None) -> DataFrame:
    """Adds ``batch_id`` to rows that still carry position and series size; one ordered epoch.

    A batch is served only while another row follows its end, so the last one, full or not, is left
    out; a series with no served batch gives its first ``size`` rows as a single short batch.
    """
    start = min_index + length
    stop = F.col(SIZE) - delay - 1 if max_index is None else F.lit(max_index)
    served = F.floor((stop - start - 1) / size)
    batch = F.floor((F.col(RN) - start) / size)
    inside = (F.col(RN) >= start) & (F.col(RN) < stop)
    return windows.withColumn("batch_id", batch).filter(inside & (batch < F.greatest(served, F.lit(1))))


def draws(keys, ts: str, fraction: float, seed: int):
    """How often a row is drawn: a Poisson number of mean ``fraction``, read off a hash of its key and
    the seed. A lost task therefore draws the same rows again, however they are partitioned."""
    digest = F.md5(F.concat_ws("|", *keys, F.col(ts).cast("string"), F.lit(seed)))
    uniform = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))
    copies, term, total = [], exp(-fraction), exp(-fraction)
    while term > 1e-12:
        copies.append((uniform >= F.lit(total)).cast("int"))
        term *= fraction / len(copies)
        total += term
    return reduce(add, copies)


def sample_windows(df, columns, length: int, fraction: float, seed: int, keys=KEYS, ts="ts") -> DataFrame:
    """(keys, ts, window, draw): random look-back windows with replacement, about ``fraction`` of the
    rows in all. Rows are drawn first; a chunk's rows are gathered once and only drawn windows are cut."""
    chunks = with_chunks(index_rows(df, keys, ts), length)
    start = F.col(RN).alias("rn")
    drawn = F.when(~F.col(HALO) & (F.col(RN) >= length), draws(keys, ts, fraction, seed)).otherwise(0)
    row = F.struct(start, F.col(ts).alias("ts"), drawn.alias("drawn"), F.struct(*columns).alias("w"))
    gathered = chunks.groupBy(*keys, CHUNK).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    hits = F.transform("_rows", lambda r, i: F.struct(i.alias("i"), r["ts"].alias("ts"), r["drawn"].alias("drawn")))
    picked = gathered.select(*keys, "_rows", F.explode(F.filter(hits, lambda h: h["drawn"] > 0)).alias("_hit"))
    window = F.transform(F.slice("_rows", F.col("_hit.i") - length + 1, length), lambda r: r["w"])
    cut = picked.select(*keys, F.col("_hit.ts").alias(ts), window.alias("window"), F.col("_hit.drawn").alias("_n"))
    return cut.withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def permuted(position: Column, size: Column, epoch: Column, rounds: int = 4) -> Column:
    """Where a position of 0 .. size - 1 stands in the epoch's order: a keyed bijection, so that no rows are sorted or drawn twice.

    Positions are pairs (left, right) of a grid of a = ceil(sqrt(size)) columns with as many rows as are needed; each round adds to one of them a
    function of the other one and the epoch. The few pairs beyond ``size`` go round once more, until they are inside.
    """
    width = F.ceil(F.sqrt(size.cast("double"))).cast("bigint")
    height = F.ceil(size / width).cast("bigint")

    def mixed(value: Column, number: int) -> Column:
        return ((value + 1) * (F.lit(48271 + 2 * number) + epoch * 7919) % 2147483647 * 69621 + epoch * 40692) % 2147483647

    def once(x: Column) -> Column:
        state = F.struct((x % width).alias("l"), F.floor(x / width).cast("bigint").alias("r"))
        for n in range(rounds):
            step = (lambda n: lambda s: F.struct(F.pmod(s["l"] + mixed(s["r"], n), width).alias("l"), s["r"].alias("r")) if n % 2 == 0
                    else F.struct(s["l"].alias("l"), F.pmod(s["r"] + mixed(s["l"], n), height).alias("r")))(n)
            state = F.get(F.transform(F.array(state), step), F.lit(0))
        return F.get(F.transform(F.array(state), lambda s: s["r"] * width + s["l"]), F.lit(0))

    first = once(position)
    # at most ``width`` pairs are beyond the size, so that many steps always lead back inside
    inside = F.aggregate(F.sequence(F.lit(1).cast("bigint"), width), first, lambda y, _: F.when(y < size, y).otherwise(once(y)))
    return F.when(first < size, first).otherwise(inside)


def shuffled_batches(df, batch: int, epochs: int, first_epoch: int = 0, keys=KEYS, ts="ts") -> DataFrame:
    """Every row once for each epoch, with its ``epoch``, ``batch`` and ``slot`` in an order that differs by epoch: batch b has the rows with the
    order's numbers b x batch to (b + 1) x batch - 1, the last one may be short. Rows are addressed by position; nothing is sorted."""
    indexed = index_rows(df, keys, ts)
    each = indexed.withColumn("epoch", F.explode(F.sequence(F.lit(first_epoch).cast("bigint"), F.lit(first_epoch + epochs - 1).cast("bigint"))))
    placed = each.withColumn("_place", permuted(F.col(RN).cast("bigint"), F.col(SIZE).cast("bigint"), F.col("epoch")))
    out = placed.withColumns({"batch": F.floor(F.col("_place") / batch).cast("bigint"), "slot": F.pmod("_place", F.lit(batch)).cast("bigint")})
    return out.drop("_place", RN, SIZE)


def hopping_frames(df, size: int, hop: int, keys=KEYS, ts="ts", value="value") -> DataFrame:
    """Frames of ``size`` rows starting every ``hop`` rows: count, first stamp, minimum, maximum.

    A frame is a window that looks ahead from its first row; no row is copied for each of its frames.
    """
    chunks = with_chunks(index_rows(df, keys, ts).select(*keys, ts, value, RN, SIZE), 0, size - 1)
    ahead = chunk_window(keys).rowsBetween(0, size - 1)
    framed = chunks.withColumns({"min_value": F.min(value).over(ahead), "max_value": F.max(value).over(ahead)})
    starts = framed.filter(~F.col(HALO) & (F.col(RN) % hop == 0))
    return starts.select(
        *keys, (F.col(RN) / hop).cast("bigint").alias("frame"), F.least(F.lit(size), F.col(SIZE) - F.col(RN)).cast("bigint").alias("rows"),
        F.col(ts).alias("first_ts"), "min_value", "max_value",
    )


def first_n(df, n: int, keys=KEYS, ts="ts", last=False) -> DataFrame:
    """The first (or last) n rows of each series, by position."""
    wanted = F.col(RN) >= F.col(SIZE) - n if last else F.col(RN) < n
    return index_rows(df, keys, ts).filter(wanted).drop(RN, SIZE)


def teacher_forcing(encode, decode):
    """Array expression: the encode block followed by the decode block without its last step."""
    return F.concat(encode, F.slice(decode, 1, F.size(decode) - 1))


def week_counter(df, keys=KEYS, ts="ts") -> DataFrame:
    """Position within (series, calendar year, ISO week), from 0; a week bounds the group."""
    week = W.partitionBy(*keys, F.year(ts), F.weekofyear(ts)).orderBy(ts)
    return df.withColumn("idx", F.row_number().over(week) - 1)

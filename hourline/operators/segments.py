"""Ordered work on a series without putting the series into one task.

A window over ``partitionBy(series)`` sends a whole series to one task, and one series may hold a
third of all rows. The functions here cut each series into segments of a fixed number of calendar
days (or chunks of a fixed number of rows), work inside the pieces, and carry between pieces only
one summary row per piece:

* ``attach_totals``  whole-series sums / minima / maxima next to every row,
* ``index_rows``     the exact 0-based position of every row in its series,
* ``with_chunks``    chunks of consecutive rows with copies of the neighbouring rows they need,
* ``attach_series``  one row per series joined to the rows without a hot join key.

All are exact. (series, ts) is unique in a tidy table, so a segment has at most as many rows as
its days have time steps, and the summary has at most (time span / segment width) rows per series:
that bound holds however the rows are spread over the series.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourline.functions.dates import epoch_day

SEG = "_seg"          # segment number: epoch day / segment width
START = "_start"      # rows of the series before this segment
RN = "_rn"            # 0-based row position in the series
SIZE = "_n"           # rows in the series
CHUNK = "_chunk"      # chunk number: row position / chunk size
HALO = "_halo"        # true for a copied neighbour row
SEGMENT_DAYS = 64


def segment_of(ts: str, days: int = SEGMENT_DAYS) -> Column:
    """Segment number. 64 days of hours are 1,536 rows; give fewer days for finer steps."""
    return F.floor(epoch_day(F.col(ts)) / F.lit(days))


def raw_piece(ts: str, *columns: str) -> Column:
    """Piece number for rows that are not unique by (series, ts): segment of time x 64 hash buckets.

    For raw observations only totals make sense, not positions, so any cut will do. It is never NULL:
    rows without a stamp count as segment 0. A series has at most 64 pieces for each segment of its span.
    """
    return F.coalesce(segment_of(ts).cast("bigint"), F.lit(0)) * 64 + F.pmod(F.xxhash64(ts, *columns), F.lit(64))


def attach_raw_totals(df, keys, ts, sums=None, mins=None, maxs=None) -> DataFrame:
    """Totals next to raw observations, rows without a stamp included, joined on (keys, piece).

    The totals are mergeable, so they are summed by series on the map side; no summary of pieces is gathered."""
    used = [c for c in df.columns if c not in (*keys, ts)]
    folds = [(F.sum, sums or {}), (F.min, mins or {}), (F.max, maxs or {})]
    named = [fold(expr).alias(name) for fold, exprs in folds for name, expr in exprs.items()]
    whole = df.filter(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    totals = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias(SIZE), *named)
    return attach_series(df, totals, keys, raw_piece(ts, *used))


def in_pieces(df, keys, piece: Column) -> DataFrame:
    """Adds the piece number; a row without a key belongs to no series and drops out, as does one for
    which the piece is NULL (a segment needs a stamp).

    Joins below use this frame twice. The explicit filter is what Catalyst would infer for one side
    of the join only, and keeps both sides equal, so that they share one scan and aggregation.
    """
    cut = df.withColumn(SEG, piece)
    return cut.filter(reduce(and_, [F.col(c).isNotNull() for c in [*keys, SEG]]))


def segment_totals(cut, keys, sums=None, mins=None, maxs=None) -> DataFrame:
    """One row per (keys, piece): its first row position, the series size, and series-wide totals.

    Rows are pre-aggregated to pieces on the map side; the window runs on the summary only. Each of
    ``sums`` / ``mins`` / ``maxs`` maps a new column to the expression to fold.
    """
    folds = [(F.sum, sums or {}), (F.min, mins or {}), (F.max, maxs or {})]
    named = [(fold, name, expr) for fold, exprs in folds for name, expr in exprs.items()]
    partial = cut.groupBy(*keys, SEG).agg(
        F.count(F.lit(1)).alias("_rows"), *[fold(expr).alias(name) for fold, name, expr in named]
    )
    series = W.partitionBy(*keys)
    earlier = series.orderBy(SEG).rowsBetween(W.unboundedPreceding, -1)
    return partial.select(
        *keys,
        SEG,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias(START),
        F.sum("_rows").over(series).alias(SIZE),
        *[fold(name).over(series).alias(name) for fold, name, _ in named],
    )


def attach_totals(df, keys, ts, sums=None, mins=None, maxs=None, piece=None, keep=()) -> DataFrame:
    """Every row with its series-wide totals, joined on (keys, piece); the default piece is a segment.

    Of the helper columns only those in ``keep`` stay. Rows with a NULL ts drop out.
    """
    cut = in_pieces(df, keys, segment_of(ts) if piece is None else piece)
    out = cut.join(segment_totals(cut, keys, sums, mins, maxs), [*keys, SEG])
    return out.drop(*[c for c in (SEG, START, SIZE) if c not in keep])


def index_rows(df, keys, ts, sums=None, mins=None, maxs=None, days: int = SEGMENT_DAYS) -> DataFrame:
    """Every row with its exact position ``_rn`` (by ts, from 0) and the series size ``_n``."""
    inside = W.partitionBy(*keys, SEG).orderBy(ts)
    return (
        attach_totals(df, keys, ts, sums, mins, maxs, piece=segment_of(ts, days), keep=(SEG, START, SIZE))
        .withColumn(RN, F.col(START) + F.row_number().over(inside) - 1)
        .drop(START, SEG)
    )


def with_chunks(indexed, before: int, after: int = 0, rows: int | None = None) -> DataFrame:
    """Copy each row to its chunk and, near an edge, to the neighbour chunk that looks at it.

    ``before`` / ``after`` is how far a row looks back / ahead, in rows. A chunk is at least eight
    times that, so at most an eighth of the rows travel twice.
    """
    size = max(rows or 1024, 8 * (before + after))
    own = F.floor(F.col(RN) / F.lit(size))
    place = F.col(RN) % size
    copies = F.array(
        own,
        F.when(place >= size - before, own + 1),
        F.when((place < after) & (own > 0), own - 1),
    )
    return indexed.withColumn(CHUNK, F.explode(F.array_compact(copies))).withColumn(
        HALO, F.col(CHUNK) != own
    )


def chunk_window(keys):
    return W.partitionBy(*keys, CHUNK).orderBy(RN)


def with_past_days(df, ts, reach: int, days=SEGMENT_DAYS) -> DataFrame:
    """Segments in which each row also finds the ``reach`` calendar days before the segment."""
    width = max(days, 8 * reach)
    own = segment_of(ts, width)
    at_end = F.pmod(epoch_day(F.col(ts)), F.lit(width)) >= width - reach
    copies = F.array_compact(F.array(own, F.when(at_end, own + 1)))
    return df.withColumn(SEG, F.explode(copies)).withColumn(HALO, F.col(SEG) != own)


def attach_series(df, per_series, keys, piece: Column) -> DataFrame:
    """Join one-row-per-series data to all rows on (keys, piece) rather than on keys.

    ``piece`` cuts a series into parts of bounded size, such as ``segment_of(ts)``. ``per_series`` is
    first copied to the pieces its series has (a join of summaries), so the big join has no key
    heavier than one piece.
    """
    cut = in_pieces(df, keys, piece)
    spread = cut.select(*keys, SEG).distinct().join(per_series, list(keys))
    return cut.join(spread, [*keys, SEG]).drop(SEG)

"""Row-level cleaning, filters and deduplication."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.functions.dates import epoch_second, hour_start
from hourline.functions.parse import strict_int

DOUBLE_MAX = 1.7976931348623157e308


def _missing(df, columns=None):
    """One boolean per column: NULL, or NaN in a floating column."""
    types = dict(df.dtypes)
    names = columns or df.columns
    return [
        F.col(c).isNull() | F.isnan(c) if types[c] in ("double", "float") else F.col(c).isNull()
        for c in names
    ]


def drop_null_rows(df, columns=None) -> DataFrame:
    return df.filter(~reduce(or_, _missing(df, columns)))


def null_rows(df, columns=None) -> DataFrame:
    return df.filter(reduce(or_, _missing(df, columns)))


def fill_zero(df, column="value") -> DataFrame:
    """NULL and NaN to 0; infinities to the largest double of their sign."""
    v = F.coalesce(F.nanvl(F.col(column), F.lit(0.0)), F.lit(0.0))
    inf = F.lit(float("inf"))
    return df.withColumn(
        column, F.when(v == inf, F.lit(DOUBLE_MAX)).when(v == -inf, F.lit(-DOUBLE_MAX)).otherwise(v)
    )


def rescale_units(df, columns, factor=1000.0) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.lit(float(factor)) for c in columns})


def cast_columns(df, types: dict[str, str]) -> DataFrame:
    """Casts to int truncate toward zero."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def dedupe_ts(df, keys, values, order) -> DataFrame:
    """One row per key: for each value column its first non-NULL value by ``order``.

    ``min_by`` keeps one candidate per key on the map side, so many copies of one key cost nothing
    in the shuffle, and unlike ``first`` it does not depend on row arrival.
    """
    return df.groupBy(*keys).agg(
        *[F.min_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values]
    )


def validate_ints(df, columns, required=()) -> tuple[DataFrame, DataFrame]:
    """Split rows into (good, rejects).

    Good rows have every ``required`` column present and every text in ``columns`` a whole integer;
    those columns come back as INT. Rejects keep the raw text and name the first failing column.
    """
    checks = [(c, F.col(c).isNotNull()) for c in required]
    checks += [(c, strict_int(F.col(c)).isNotNull()) for c in columns]
    ok = reduce(and_, [check for _, check in checks])
    good = df.filter(ok).withColumns({c: strict_int(F.col(c)) for c in columns})
    reason = F.coalesce(*[F.when(~check, F.lit(c)) for c, check in checks])
    return good, df.filter(~ok).withColumn("reason", reason)


def hourly_mean(df, values, keys=(), ts="ts") -> DataFrame:
    """Average sub-hour observations to the hour."""
    return df.groupBy(*keys, hour_start(F.col(ts)).alias(ts)).agg(*[F.avg(v).alias(v) for v in values])


def split_by_year(df, year: int, ts="ts") -> DataFrame:
    """Rows of one year, written as a half-open range so that file statistics can skip data."""
    low, high = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz") for y in (year, year + 1))
    return df.filter((F.col(ts) >= low) & (F.col(ts) < high))


def other_years(df, year: int, ts="ts") -> DataFrame:
    """Rows of every other year, before and after."""
    low, high = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz") for y in (year, year + 1))
    return df.filter((F.col(ts) < low) | (F.col(ts) >= high))


def _period(label: str) -> tuple[dt.datetime, dt.datetime]:
    """First moment of a period and of the one after it: a year, month, day, or hour of a day."""
    day, _, hour = label.strip().replace("T", " ").partition(" ")
    parts = [int(p) for p in day.split("-")]
    first = dt.datetime(*(parts + [1, 1])[:3])
    if hour:
        if len(parts) < 3 or not hour.isdigit():
            raise ValueError(f"not a period: {label!r}")
        first += dt.timedelta(hours=int(hour))
        return first, first + dt.timedelta(hours=1)
    if len(parts) == 3:
        return first, first + dt.timedelta(days=1)
    year, month = (parts[0] + 1, 1) if len(parts) == 1 else (parts[0] + parts[1] // 12, parts[1] % 12 + 1)
    return first, dt.datetime(year, month, 1)


def slice_period(df, start: str, end: str, ts="ts") -> DataFrame:
    """Partial-date slice with both ends included: '2010', '2010-01', '2010-01-31' or '2010-01-31 05'."""
    low, high = (F.lit(str(x)).cast("timestamp_ntz") for x in (_period(start)[0], _period(end)[1]))
    return df.filter((F.col(ts) >= low) & (F.col(ts) < high))


def time_block(df, start, end, ts="ts") -> DataFrame:
    """Closed block of every series."""
    low, high = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return df.filter(F.col(ts).between(low, high))


def range_semi(df, start, end, step_hours=1, ts="ts") -> DataFrame:
    """Rows whose stamp lies on the inclusive grid start, start + step, ..., end.

    The grid has a size fixed by its arguments, and membership is arithmetic, so no join is needed.
    """
    low, high = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    stamp = F.col(ts)
    on_grid = F.pmod(epoch_second(stamp) - epoch_second(low), F.lit(step_hours * 3600)) == 0
    whole = stamp == F.to_date(stamp).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.hour(stamp), F.minute(stamp), F.second(stamp)
    )
    return df.filter(stamp.between(low, high) & on_grid & whole)


def union_by_name(frames) -> DataFrame:
    """Union by column name; a column absent from one frame is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)



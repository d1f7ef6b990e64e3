"""Rolling-origin cross-validation.

The cutoffs of a series lie on a regular grid, last - horizon - k * period for k = 0, 1, ..., as
far back as first + initial. Which cutoffs a row belongs to is therefore arithmetic on its own
stamp; no range join is needed. Rows must carry ``_first`` and ``_last`` (see ``attach_totals``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourline.functions.dates import epoch_second, hours_interval
from hourline.operators.lags import calendar_lag
from hourline.operators.segments import attach_totals

KEYS = ("series",)
HOUR = 3600
Z80 = 1.2815515655446004  # fixed value: half-width of the central 80 % of a standard normal


def cutoff_count(initial: int, period: int, horizon: int) -> Column:
    """How many cutoffs the series has (0 when the history is too short); arguments in hours."""
    room = epoch_second(F.col("_last")) - epoch_second(F.col("_first")) - (initial + horizon) * HOUR
    return F.greatest(F.floor(room / (period * HOUR)) + 1, F.lit(0))


def cutoff_ts(k: Column, period: int, horizon: int) -> Column:
    return F.col("_last") - hours_interval(horizon) - hours_interval((k * period).cast("int"))


def cutoff_rows(ts, initial: int, period: int, horizon: int) -> Column:
    """Array of the cutoffs k whose horizon (cutoff, cutoff + horizon] holds the row."""
    back = epoch_second(F.col("_last")) - epoch_second(F.col(ts))
    low = F.greatest(F.floor((back - horizon * HOUR) / (period * HOUR)) + 1, F.lit(0))
    high = F.least(F.floor(back / (period * HOUR)), cutoff_count(initial, period, horizon) - 1)
    return F.when(low <= high, F.sequence(low, high))


def training_interval(ts, initial: int, period: int, horizon: int) -> Column:
    """The earliest cutoff (largest k) that may train on the row; negative when none may.

    The row then also trains every later cutoff, that is every smaller k.
    """
    room = epoch_second(F.col("_last")) - epoch_second(F.col(ts)) - horizon * HOUR
    return F.least(F.floor(room / (period * HOUR)), cutoff_count(initial, period, horizon) - 1)


def _ranged(df, keys, ts):
    stamp = F.col(ts)
    return attach_totals(df, keys, ts, mins={"_first": stamp}, maxs={"_last": stamp})


def cutoffs(df, initial_hours, period_hours, horizon_hours, keys=KEYS, ts="ts") -> DataFrame:
    """(keys, k, cutoff), newest first; k counts the periods before the last cutoff."""
    spans = df.groupBy(*keys).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    count = cutoff_count(initial_hours, period_hours, horizon_hours)
    ks = F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1))
    return spans.select(*keys, "_last", F.explode(ks).alias("k")).select(
        *keys, "k", cutoff_ts(F.col("k"), period_hours, horizon_hours).alias("cutoff")
    )


def cv_seasonal_naive(
    df, initial_hours, period_hours, horizon_hours, season_days=7, keys=KEYS, ts="ts", value="value"
) -> DataFrame:
    """(keys, cutoff, ts, actual, pred, lower, upper) of the seasonal-naive forecast at each cutoff.

    A row of the horizon without a value to repeat keeps its place with a NULL forecast.

    The forecast is the value at the last stamp of the same season at or before the cutoff. The band
    is the root mean square of the seasonal differences known at the cutoff, from running sums over
    the stretches between cutoffs.
    """
    spec = (initial_hours, period_hours, horizon_hours)
    season = season_days * 24 * HOUR
    rows = _ranged(df.select(*keys, ts, value), keys, ts)
    ahead = rows.withColumn("k", F.explode(cutoff_rows(ts, *spec))).withColumn(
        "cutoff", cutoff_ts(F.col("k"), period_hours, horizon_hours)
    )
    gap = epoch_second(F.col(ts)) - epoch_second(F.col("cutoff"))
    back_days = (F.ceil(gap / season) * season_days).cast("int")
    ahead = ahead.withColumn("_base", F.col(ts) - F.make_dt_interval(back_days))
    known = df.select(*keys, F.col(ts).alias("_base"), F.col(value).alias("pred"))
    forecast = ahead.join(known, [*keys, "_base"], "left")

    diffs = calendar_lag(rows, {"_old": (value, season_days)}, keys, ts)
    sq = (F.col(value) - F.col("_old")) ** 2
    stretch = (
        diffs.withColumn("k", training_interval(ts, *spec)).filter((F.col("k") >= 0) & sq.isNotNull())
        .groupBy(*keys, "k").agg(F.sum(sq).alias("_sq"), F.count(F.lit(1)).alias("_m"))
    )
    older = W.partitionBy(*keys).orderBy(F.col("k").desc())
    grid = cutoffs(df, *spec, keys, ts).select(*keys, "k").join(stretch, [*keys, "k"], "left")
    spread = grid.select(
        *keys, "k", F.sqrt(F.try_divide(F.sum("_sq").over(older), F.sum("_m").over(older))).alias("_s")
    )
    out = forecast.join(spread, [*keys, "k"], "left")
    return out.select(
        *keys, "cutoff", ts, F.col(value).alias("actual"), "pred",
        (F.col("pred") - Z80 * F.col("_s")).alias("lower"), (F.col("pred") + Z80 * F.col("_s")).alias("upper"),
    )


def cv_metrics(cv, keys=(), ts="ts") -> DataFrame:
    """Scores by distance from the cutoff (``horizon_hours``): mse, rmse, mae, mape, coverage.

    ``n`` rows have a forecast and ``n_missing`` have none."""
    e = F.col("actual") - F.col("pred")
    horizon = (epoch_second(F.col(ts)) - epoch_second(F.col("cutoff"))) / HOUR
    inside = (F.col("actual") >= F.col("lower")) & (F.col("actual") <= F.col("upper"))
    return cv.groupBy(*keys, horizon.alias("horizon_hours")).agg(
        F.count(e).alias("n"),
        F.count_if(e.isNull()).alias("n_missing"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(F.abs(F.try_divide(e, F.col("actual")))).alias("mape"),
        F.avg(inside.cast("int")).alias("coverage"),
    )

"""Daily means, calendar lags and the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourline.operators.calendar import calendar_features, holiday_flags
from hourline.operators.clean import drop_null_rows
from hourline.operators.segments import HALO, SEG, with_past_days

KEYS = ("series",)


def daily_mean(df, keys=KEYS, ts="ts", value="value") -> DataFrame:
    """One row per series and day."""
    return df.groupBy(*keys, F.to_date(ts).alias("date")).agg(F.avg(value).alias("daily_mean"))


def daily_mean_attach(df, keys=KEYS, ts="ts", value="value") -> DataFrame:
    """Every row with the mean of its day: one shuffle by (series, day), no join."""
    day = W.partitionBy(*keys, F.to_date(ts))
    return df.withColumn("daily_mean", F.avg(value).over(day))


def _at_days_before(column: str, days: int, keys, ts: str):
    names = ", ".join(f"`{k}`" for k in [*keys, SEG])
    return F.expr(
        f"max(`{column}`) OVER (PARTITION BY {names} ORDER BY `{ts}` "
        f"RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND INTERVAL {days} DAY PRECEDING)"
    )


def _segmented(df, keys, ts, reach):
    # One explicit shuffle by (series, segment); every window below is satisfied by it.
    return with_past_days(df, ts, reach).repartition(*keys, SEG)


def calendar_lag(df, lags: dict[str, tuple[str, int]], keys=KEYS, ts="ts") -> DataFrame:
    """Adds columns holding a value at exactly ``ts - n days``, NULL where that stamp is absent.

    ``lags`` maps a new column to (source column, days). All lags share one shuffle, in segments
    that hold copies of the last days of the segment before. (series, ts) must be unique.
    """
    reach = max(days for _, days in lags.values())
    out = _segmented(df, keys, ts, reach)
    for name, (column, days) in lags.items():
        out = out.withColumn(name, _at_days_before(column, days, keys, ts))
    return out.filter(~F.col(HALO)).drop(SEG, HALO)


def lag_features(df, keys=KEYS, ts="ts", value="value", day_lag=1, week_lag=7) -> DataFrame:
    """Value one day and one week ago, and yesterday's daily mean read at the same hour.

    The daily mean is NULL-lagged when yesterday lacks the same hour, as the hourly lag is.
    """
    day = W.partitionBy(*keys, SEG, F.to_date(ts))
    out = _segmented(df, keys, ts, max(day_lag, week_lag)).withColumn("daily_mean", F.avg(value).over(day))
    out = out.withColumns(
        {
            "prev_day": _at_days_before(value, day_lag, keys, ts),
            "prev_week_day": _at_days_before(value, week_lag, keys, ts),
            "prev_day_mean": _at_days_before("daily_mean", day_lag, keys, ts),
        }
    )
    return out.filter(~F.col(HALO)).drop(SEG, HALO)


CALENDAR_GROUP = ["hour_num", "day_num", "month", "day", "day_year", "week_year", "off_flag"]
LAG_GROUP = ["prev_day", "prev_week_day", "prev_day_mean"]
WEATHER_GROUP = ["drybulb", "humidity"]


def features(df, keys=KEYS, ts="ts", value="value", calendar=True, lag=True, weather=None) -> DataFrame:
    """The full feature table; the three groups switch independently. Rows with a NULL drop out."""
    columns = [*keys, ts, value]
    out = df
    if weather is not None:
        out = join_weather(out, weather, ts)
        columns += WEATHER_GROUP
    if lag:
        out = lag_features(out, keys, ts, value)
        columns += LAG_GROUP
    if calendar:
        out = holiday_flags(calendar_features(out, ts), ts=ts)
        columns += CALENDAR_GROUP
    return drop_null_rows(out.select(*columns))


def join_weather(load, weather, ts="ts") -> DataFrame:
    """Inner join on the stamp. Several weather rows of one stamp are averaged first, so no load row is
    doubled, and the weather's size is bounded by the time span."""
    typed = weather.withColumn(ts, F.col(ts).cast("timestamp_ntz"))
    typed = typed.groupBy(ts).agg(*[F.avg(c).alias(c) for c in weather.columns if c != ts])
    return load.withColumn(ts, F.col(ts).cast("timestamp_ntz")).join(typed, ts)


def feature_groups(df, groups, keys=KEYS, ts="ts", value="value") -> DataFrame:
    """Keep the key, the target and the named groups out of calendar, weather and lag."""
    named = {"calendar": CALENDAR_GROUP, "weather": WEATHER_GROUP, "lag": LAG_GROUP}
    return df.select(*keys, ts, value, *[c for g in groups for c in named[g]])

"""Seasonal-naive baseline: the value a whole number of weeks ago, with percentile bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.operators.lags import calendar_lag
from hourline.operators.segments import attach_series, segment_of

KEYS = ("series",)


def seasonal_naive(df, days=7, keys=KEYS, ts="ts", value="value") -> DataFrame:
    """(keys, ts, actual, pred): pred is the value ``days`` earlier; rows without one drop out."""
    lagged = calendar_lag(df, {"pred": (value, days)}, keys, ts)
    return lagged.filter(F.col("pred").isNotNull()).select(*keys, ts, F.col(value).alias("actual"), "pred")


def percentile_bands(train, quantiles: dict[str, float], keys=KEYS, ts="ts", value="value") -> DataFrame:
    """(keys, day_num, hour_num, <names>): exact percentiles per weekday and hour.

    One cell of one series gains one value a week, so a group is bounded by the weeks covered.
    """
    cell = [F.weekday(ts).alias("day_num"), F.hour(ts).alias("hour_num")]
    return train.groupBy(*keys, *cell).agg(
        *[F.percentile(value, q).alias(name) for name, q in quantiles.items()]
    )


def with_bands(forecast, bands, keys=KEYS, ts="ts") -> DataFrame:
    """Forecast rows with the band of their weekday and hour.

    Bands fold to one row per series (at most 168 cells) before they meet the rows by segment.
    """
    names = [c for c in bands.columns if c not in (*keys, "day_num", "hour_num")]
    cell = F.col("day_num") * 24 + F.col("hour_num")
    entries = F.collect_list(F.struct(cell.alias("c"), F.struct(*names).alias("v")))
    per_series = bands.groupBy(*keys).agg(F.map_from_entries(entries).alias("_bands"))
    joined = attach_series(forecast, per_series, keys, segment_of(ts))
    own = F.element_at("_bands", F.weekday(ts) * 24 + F.hour(ts))
    return joined.withColumn("_own", own).select(*forecast.columns, *[F.col(f"_own.{n}").alias(n) for n in names])

"""Forecast scores, reports and distributions, on seasonal-naive forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourline.operators import clean, distribution, metrics, naive, scale
from hourline.operators.lags import calendar_lag, join_weather
from hourline.plans import workload as w
from hourline.plans.catalog import query, tidy


def naive_hourly(spark, folder):
    return naive.seasonal_naive(w.hourly_load(spark, folder))


def banded(spark, folder):
    """Year 2000 of the daily load: actual, forecast and the 5 / 50 / 95 % bands of the other years."""
    bands = naive.percentile_bands(
        w.daily_load(spark, folder, without_year=2000), {"lower": 0.05, "mid": 0.5, "upper": 0.95}
    )
    # a week before the year for its first forecasts
    load = w.daily_load(spark, folder, "1999-12-25", "2001-01-01")
    return naive.with_bands(clean.split_by_year(naive.seasonal_naive(load), 2000), bands)


def with_gaps(frame):
    """The frame with every fifth forecast missing."""
    return frame.withColumn("pred", F.when(F.dayofyear("ts") % 5 != 0, F.col("pred")))


N = f"WITH {w.NAIVE_HOURLY_SQL} "
B = f"WITH {w.NAIVE_DAILY_SQL} "


@query("seasonal_naive", N + "SELECT * FROM naive")
def seasonal_naive(spark, folder):
    return tidy(naive_hourly(spark, folder))


@query("mae", N + "SELECT series, round(avg(abs(actual - pred)), 6) AS mae FROM naive GROUP BY 1")
def mae(spark, folder):
    """Actuals and forecasts meet by key; a key missing on one side would stop the query."""
    frame = naive_hourly(spark, folder)
    aligned = metrics.align(frame.drop("pred"), frame.drop("actual"), ["series", "ts"])
    return tidy(metrics.mae(aligned))


@query(
    "mape",
    N + """SELECT series, round(avg(CASE WHEN actual <> 0 THEN abs((actual - pred) / actual) END), 6) AS mape,
           count(*) FILTER (WHERE actual = 0)::BIGINT AS n_zero FROM naive GROUP BY 1""",
)
def mape(spark, folder):
    return tidy(metrics.mape(naive_hourly(spark, folder)))


@query(
    "accuracy",
    N + """SELECT series, round(1 - avg(abs(actual - pred)) / avg(actual), 6) AS accuracy,
           (count(*) FILTER (WHERE NOT has))::BIGINT AS n_missing
    FROM (SELECT series, has, CASE WHEN has THEN actual END AS actual, CASE WHEN has THEN pred END AS pred
          FROM (SELECT *, dayofyear(ts) % 5 <> 0 AS has FROM naive)) GROUP BY 1""",
)
def accuracy(spark, folder):
    return tidy(metrics.accuracy(with_gaps(naive_hourly(spark, folder))))


@query(
    "r2",
    N + """, k AS (SELECT * FROM naive WHERE dayofyear(ts) % 5 <> 0),
    m AS (SELECT series, avg(actual) AS m FROM k GROUP BY 1),
    s AS (SELECT series, round(1 - sum((actual - pred) ** 2) / sum((actual - m) ** 2), 6) AS r2
          FROM k JOIN m USING (series) GROUP BY 1)
    SELECT series, any_value(r2) AS r2, (count(*) FILTER (WHERE dayofyear(ts) % 5 = 0))::BIGINT AS n_missing
    FROM naive LEFT JOIN s USING (series) GROUP BY 1""",
)
def r2(spark, folder):
    return tidy(metrics.r2(with_gaps(naive_hourly(spark, folder))))


@query(
    "pinball",
    B + """SELECT series, round(avg(greatest(0.95::DOUBLE * (actual - upper), (0.95 - 1)::DOUBLE * (actual - upper))), 7) AS pinball
    FROM banded GROUP BY 1""",
)
def pinball(spark, folder):
    rows = banded(spark, folder).drop("pred").withColumnRenamed("upper", "pred")
    return tidy(metrics.pinball(rows, 0.95), 7)


@query(
    "quantile_score",
    B + """SELECT series, round(1e6 / sum(greatest(0.05::DOUBLE * (actual - lower), (0.05 - 1)::DOUBLE * (actual - lower))), 6)
           AS quantile_score FROM banded GROUP BY 1""",
)
def quantile_score(spark, folder):
    rows = banded(spark, folder).drop("pred").withColumnRenamed("lower", "pred")
    return tidy(metrics.quantile_score(rows, 0.05).withColumn("quantile_score", F.col("quantile_score") * 1e6))


@query("interval_table", B + "SELECT series, ts, actual, pred, round(lower, 4) AS lower, round(upper, 4) AS upper FROM banded")
def interval_table(spark, folder):
    """The band is part of the banded frame already, so nothing is joined."""
    return tidy(banded(spark, folder).drop("mid"), 4)


@query(
    "interval_join",
    f"""WITH {w.HOURLY_LOAD_SQL}, a AS (
      SELECT a.series, a.ts, a.value AS actual, b.value AS pred FROM hourly_load a
      JOIN hourly_load b ON b.series = a.series AND b.ts = a.ts - INTERVAL 1 DAY),
    lo AS (SELECT a.series, a.ts, b.value AS lower FROM hourly_load a
      JOIN hourly_load b ON b.series = a.series AND b.ts = a.ts - INTERVAL 2 DAY),
    up AS (SELECT a.series, a.ts, b.value AS upper FROM hourly_load a
      JOIN hourly_load b ON b.series = a.series AND b.ts = a.ts - INTERVAL 7 DAY)
    SELECT series, ts, actual, pred, lower, upper FROM a FULL JOIN lo USING (series, ts) FULL JOIN up USING (series, ts)""",
)
def interval_join(spark, folder):
    """Three separate forecasts side by side; hours that only some of them have keep their row."""
    load = w.hourly_load(spark, folder)
    low, high = (naive.seasonal_naive(load, days=d).drop("actual") for d in (2, 7))
    return tidy(metrics.interval_table(naive.seasonal_naive(load, days=1), low, high))


@query(
    "interval_breaches",
    B + """SELECT series, count(*) FILTER (WHERE actual > upper)::BIGINT AS upper_breaches,
           round(avg((actual > upper)::INT), 6) AS upper_rate,
           count(*) FILTER (WHERE actual < lower)::BIGINT AS lower_breaches,
           round(avg((actual < lower)::INT), 6) AS lower_rate FROM banded GROUP BY 1""",
)
def interval_breaches(spark, folder):
    return tidy(metrics.interval_breaches(banded(spark, folder)))


def _blocks_sql(block):
    return f""", k AS (
      SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS rn, count(*) OVER (PARTITION BY series) AS n
      FROM naive),
    blocks AS (
      SELECT series, rn // {block} AS step, avg(abs(actual - pred)) AS mae,
             avg(CASE WHEN actual <> 0 THEN abs((actual - pred) / actual) END) AS mape
      FROM k WHERE rn // {block} < n // {block} GROUP BY 1, 2)"""


@query("mape_per_step", N + _blocks_sql(168) + "SELECT series, step::BIGINT AS step, round(mape, 6) AS mape FROM blocks")
def mape_per_step(spark, folder):
    return tidy(metrics.per_block(naive_hourly(spark, folder), "mape", 168))


@query(
    "mae_per_step",
    N + _blocks_sql(168) + """SELECT series, count(*)::BIGINT AS steps, round(avg(mae), 4) AS mae FROM blocks GROUP BY 1""",
)
def mae_per_step(spark, folder):
    """Forecast made on the scaled load, scored after undoing the scaling, then averaged over blocks."""
    load = w.hourly_load(spark, folder)
    scaled = scale.minmax_scale(load, ["value"], F.lit(True), keep_state=True)
    lagged = calendar_lag(scaled, {"pred": ("value", 7)}).filter(F.col("pred").isNotNull())
    back = scale.minmax_inverse(scale.minmax_inverse(lagged, "value", "pred"), "value", "value")
    frame = back.select("series", "ts", F.col("value").alias("actual"), "pred")
    return tidy(metrics.mean_of_blocks(metrics.per_block(frame, "mae", 168), "mae"), 4)


@query(
    "mape_daily",
    N + _blocks_sql(24) + "SELECT series, count(*)::BIGINT AS steps, round(avg(mape), 6) AS mape FROM blocks GROUP BY 1",
)
def mape_daily(spark, folder):
    return tidy(metrics.mean_of_blocks(metrics.per_block(naive_hourly(spark, folder), "mape", 24), "mape"))


@query(
    "trimmed_mean",
    f"""WITH {w.NAIVE_DAILY_SQL}""" + _blocks_sql(24) + """,
    ranked AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY mape DESC, step DESC) AS k FROM blocks)
    SELECT series, round(avg(mape), 6) AS trimmed_mean FROM ranked WHERE k > 30 GROUP BY 1""",
)
def trimmed_mean(spark, folder):
    """Mean block MAPE of the daily load without the 30 worst blocks."""
    blocks = metrics.per_block(naive.seasonal_naive(w.daily_load(spark, folder)), "mape", 24)
    return tidy(metrics.trimmed_mean(blocks, "mape", 30))


@query(
    "trimmed_mean_deep",
    f"""WITH {w.DAILY_LOAD_SQL}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY series ORDER BY value DESC) AS k FROM daily_load)
    SELECT series, round(avg(value), 4) AS trimmed_mean FROM ranked WHERE k > 1500 GROUP BY 1""",
)
def trimmed_mean_deep(spark, folder):
    """Mean daily load without the 1,500 largest days."""
    return tidy(metrics.trimmed_mean(w.daily_load(spark, folder), "value", 1500), 4)


@query(
    "mape_horizons",
    N + """, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS rn FROM naive)
    SELECT series, s::BIGINT AS steps, round(avg(CASE WHEN actual <> 0 THEN abs((actual - pred) / actual) END), 6) AS mape
    FROM k JOIN (SELECT unnest([1, 3, 10]) AS s) ON rn < s * 168 GROUP BY 1, 2""",
)
def mape_horizons(spark, folder):
    return tidy(metrics.cumulative(naive_hourly(spark, folder), "mape", [1, 3, 10], 168))


@query(
    "forecast_slices",
    N + """, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS rn FROM naive)
    SELECT series, ts, actual, pred, lo::VARCHAR || '-' || hi::VARCHAR AS horizon
    FROM k JOIN (VALUES (0, 1), (0, 3), (1, 2)) AS h(lo, hi) ON rn >= lo * 168 AND rn < hi * 168""",
)
def forecast_slices(spark, folder):
    return tidy(metrics.forecast_slices(naive_hourly(spark, folder), [(0, 1), (0, 3), (1, 2)], 168))


@query(
    "compare_forecasts",
    f"""WITH {w.HOURLY_LOAD_SQL}
    SELECT a.series, a.ts, a.value AS actual, d.value AS day_naive, k.value AS week_naive,
           round(d.value - a.value, 6) AS day_naive_err, round(k.value - a.value, 6) AS week_naive_err
    FROM hourly_load a
    LEFT JOIN hourly_load d ON d.series = a.series AND d.ts = a.ts - INTERVAL 1 DAY
    LEFT JOIN hourly_load k ON k.series = a.series AND k.ts = a.ts - INTERVAL 7 DAY""",
)
def compare_forecasts(spark, folder):
    load = w.hourly_load(spark, folder)
    forecasts = {
        "day_naive": naive.seasonal_naive(load, days=1).drop("actual"),
        "week_naive": naive.seasonal_naive(load, days=7).drop("actual"),
    }
    return tidy(metrics.compare_forecasts(load.withColumnRenamed("value", "actual"), forecasts))


@query(
    "histogram",
    """WITH r AS (SELECT event_type AS series, min(value) AS lo, max(value) AS hi, count(*) AS total FROM events GROUP BY 1),
    b AS (SELECT e.event_type AS series, lo, hi, total,
                 least(floor((value - lo) / (hi - lo) * 25)::BIGINT + 1, 25) AS bin
          FROM events e JOIN r ON r.series = e.event_type)
    SELECT series, bin, round(lo + (bin - 1) * (hi - lo) / 25, 6) AS low, round(lo + bin * (hi - lo) / 25, 6) AS high,
           count(*)::BIGINT AS n, round(count(*) / (total * (hi - lo) / 25), 6) AS density
    FROM b GROUP BY series, bin, lo, hi, total""",
)
def histogram(spark, folder):
    events = w.table(spark, folder, "events").withColumnRenamed("event_type", "series")
    return tidy(distribution.histogram(events, "value", 25, density=True))


@query(
    "hist2d",
    f"""WITH {w.HOURLY_LOAD_SQL}, {w.HOURLY_WEATHER_SQL}, j AS (
      SELECT series, value, drybulb FROM hourly_load JOIN hourly_weather USING (ts)),
    r AS (SELECT series, min(value) AS vl, max(value) AS vh, min(drybulb) AS dl, max(drybulb) AS dh FROM j GROUP BY 1)
    SELECT series, least(floor((drybulb - dl) / (dh - dl) * 10)::BIGINT + 1, 10) AS x_bin,
           least(floor((value - vl) / (vh - vl) * 50)::BIGINT + 1, 50) AS y_bin, count(*)::BIGINT AS n
    FROM j JOIN r USING (series) GROUP BY 1, 2, 3""",
)
def hist2d(spark, folder):
    joined = join_weather(w.hourly_load(spark, folder), w.hourly_weather(spark, folder))
    return tidy(distribution.hist2d(joined, "drybulb", "value"))

"""The test tables as time series. Each input has the same definition in SQL (``*_SQL``).

Sums of two-decimal amounts are rounded to two decimals, so that they do not depend on the order of
addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourline.functions.dates import day_start, hour_start
from hourline.operators import clean
from hourline.operators.reshape import SEGMENT_LABELS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _between(df, ts, start, end) -> DataFrame:
    """Raw rows of [start, end), before anything is derived from the stamp: the scan sees both bounds."""
    for bound, keep in ((start, lambda b: F.col(ts) >= b), (end, lambda b: F.col(ts) < b)):
        if bound is not None:
            df = df.filter(keep(F.lit(bound).cast("timestamp_ntz")))
    return df


def _sums(df, series, ts, value) -> DataFrame:
    """One row per series and step. The NULL filter also keeps the value in every use of the frame, so
    that two branches of one plan share a single scan and aggregation (a reused exchange)."""
    sums = df.groupBy(series.alias("series"), ts.alias("ts")).agg(F.round(F.sum(value), 2).alias("value"))
    return sums.filter(F.col("value").isNotNull())


def hourly_load(spark, folder, start=None, end=None) -> DataFrame:
    events = _between(table(spark, folder, "events"), "ts", start, end)
    return _sums(events, F.col("event_type"), hour_start(F.col("ts")), "value")


def hourly_total(spark, folder) -> DataFrame:
    return _sums(table(spark, folder, "events"), F.lit("total"), hour_start(F.col("ts")), "value")


def daily_load(spark, folder, start=None, end=None, without_year=None) -> DataFrame:
    orders = _between(table(spark, folder, "orders"), "o_orderdate", start, end)
    if without_year is not None:
        orders = clean.other_years(orders, without_year, "o_orderdate")
    return _sums(orders, F.col("o_orderpriority"), day_start(F.col("o_orderdate")), "o_totalprice")


def daily_total(spark, folder) -> DataFrame:
    return _sums(
        table(spark, folder, "lineitem"), F.lit("total"), day_start(F.col("l_shipdate")), "l_extendedprice"
    )


def ship_daily(spark, folder) -> DataFrame:
    return _sums(
        table(spark, folder, "lineitem"), F.concat("l_returnflag", "l_linestatus"),
        day_start(F.col("l_shipdate")), "l_quantity",
    )


def raw_weather(spark, folder) -> DataFrame:
    """One observation per event: value and the number inside props."""
    humidity = F.regexp_extract("props", r"(\d+)", 1).cast("double")
    return table(spark, folder, "events").select("ts", F.col("value").alias("drybulb"), humidity.alias("humidity"))


def hourly_weather(spark, folder) -> DataFrame:
    return raw_weather(spark, folder).groupBy(hour_start(F.col("ts")).alias("ts")).agg(
        F.round(F.avg("drybulb"), 6).alias("drybulb"), F.round(F.avg("humidity"), 6).alias("humidity")
    )


def dirty_obs(spark, folder) -> DataFrame:
    """Observations as the raw weather file writes them: blanks, stars, suffixes and padding."""
    digits = F.floor("value").cast("string")
    case = F.col("event_id") % 10
    drybulb = (
        F.when(case == 0, "").when(case == 1, "*").when(case == 2, F.concat(digits, F.lit("s")))
        .when(case == 3, F.concat(F.lit(" "), digits, F.lit(" "))).otherwise(digits)
    )
    return table(spark, folder, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("date_s"),
        F.col("event_type").alias("kind"),
        drybulb.alias("drybulb_s"),
        F.regexp_extract("props", r"(\d+)", 1).alias("humidity_s"),
        "event_id",
    )


def dirty_load(spark, folder) -> DataFrame:
    """The hourly load as raw text: midnight is written 24:00 of the day before, thousands with commas."""
    load = hourly_load(spark, folder)
    midnight = F.hour("ts") == 0
    day = F.when(midnight, F.date_sub(F.to_date("ts"), 1)).otherwise(F.to_date("ts"))
    hour = F.when(midnight, 24).otherwise(F.hour("ts"))
    label = F.concat(F.date_format(day, "MM/dd/yyyy"), F.lit(" "), F.format_string("%02d:00", hour))
    return load.select(
        "series", label.alias("hour_s"), F.format_number(F.col("value") * 1000, 1).alias("value_s")
    )


def dup_load(spark, folder) -> DataFrame:
    """The hourly load in thousands, with the hour 1 of each day doubled: its first copy lacks a value."""
    load = hourly_load(spark, folder).select("series", "ts", (F.col("value") * 1000).alias("value"))
    second = load.withColumn("ord", F.lit(2))
    first = load.withColumn("ord", F.lit(1)).withColumn(
        "value", F.when(F.hour("ts") != 1, F.col("value"))
    )
    return first.unionByName(second.filter(F.hour("ts") == 1))


def profile_wide(spark, folder) -> DataFrame:
    """One row per type and day with 96 quarter-hour means; empty quarters are NULL."""
    label = F.concat(F.lit("seg_"), (4 + F.hour("ts") * 4 + F.floor(F.minute("ts") / 15)).cast("string"))
    events = table(spark, folder, "events").select(
        F.col("event_type").alias("Type"), F.date_format("ts", "MM/dd/yyyy").alias("Date"),
        label.alias("Segment"), "value",
    )
    return events.groupBy("Type", "Date").pivot("Segment", SEGMENT_LABELS).agg(F.round(F.avg("value"), 6))


HOURLY_LOAD_SQL = """hourly_load AS (
  SELECT event_type AS series, date_trunc('hour', ts) AS ts, round(sum(value), 2) AS value
  FROM events GROUP BY 1, 2)"""
HOURLY_TOTAL_SQL = """hourly_total AS (
  SELECT 'total' AS series, date_trunc('hour', ts) AS ts, round(sum(value), 2) AS value
  FROM events GROUP BY 1, 2)"""
DAILY_LOAD_SQL = """daily_load AS (
  SELECT o_orderpriority AS series, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
         round(sum(o_totalprice), 2) AS value
  FROM orders GROUP BY 1, 2)"""
DAILY_TOTAL_SQL = """daily_total AS (
  SELECT 'total' AS series, date_trunc('day', l_shipdate)::TIMESTAMP AS ts,
         round(sum(l_extendedprice), 2) AS value
  FROM lineitem GROUP BY 1, 2)"""
SHIP_DAILY_SQL = """ship_daily AS (
  SELECT l_returnflag || l_linestatus AS series, date_trunc('day', l_shipdate)::TIMESTAMP AS ts,
         round(sum(l_quantity), 2) AS value
  FROM lineitem GROUP BY 1, 2)"""
HOURLY_WEATHER_SQL = r"""hourly_weather AS (
  SELECT date_trunc('hour', ts) AS ts, round(avg(value), 6) AS drybulb,
         round(avg(regexp_extract(props, '(\d+)', 1)::DOUBLE), 6) AS humidity
  FROM events GROUP BY 1)"""
DIRTY_OBS_SQL = r"""dirty_obs AS (
  SELECT strftime(ts, '%Y-%m-%d %H:%M') AS date_s, event_type AS kind,
         CASE event_id % 10 WHEN 0 THEN '' WHEN 1 THEN '*'
              WHEN 2 THEN floor(value)::BIGINT::VARCHAR || 's'
              WHEN 3 THEN ' ' || floor(value)::BIGINT::VARCHAR || ' '
              ELSE floor(value)::BIGINT::VARCHAR END AS drybulb_s,
         regexp_extract(props, '(\d+)', 1) AS humidity_s, event_id
  FROM events)"""
DUP_LOAD_SQL = HOURLY_LOAD_SQL + """, dup_load AS (
  SELECT series, ts, CASE WHEN hour(ts) <> 1 THEN value * 1000 END AS value, 1 AS ord FROM hourly_load
  UNION ALL
  SELECT series, ts, value * 1000, 2 FROM hourly_load WHERE hour(ts) = 1)"""
PROFILE_LONG_SQL = """profile_cells AS (
  SELECT event_type AS "Type", strftime(ts, '%m/%d/%Y') AS "Date",
         4 + hour(ts) * 4 + minute(ts) // 15 AS seg, round(avg(value), 6) AS "Load"
  FROM events GROUP BY 1, 2, 3),
profile_long AS (
  SELECT d."Type", d."Date", 'seg_' || s.seg AS "Segment", c."Load", s.seg
  FROM (SELECT DISTINCT "Type", "Date" FROM profile_cells) d
  CROSS JOIN (SELECT unnest(range(4, 100)) AS seg) s
  LEFT JOIN profile_cells c ON c."Type" = d."Type" AND c."Date" = d."Date" AND c.seg = s.seg)"""
HOLIDAYS_SQL = """hol_years AS (SELECT unnest(range(1899, 2202)) AS y),
hol_fixed AS (
  SELECT make_date(y, m, d) AS ds, name FROM hol_years,
    (VALUES ('New Year''s Day', 1, 1), ('Independence Day', 7, 4), ('Veterans Day', 11, 11),
            ('Christmas Day', 12, 25)) AS f(name, m, d)),
hol_nth AS (
  SELECT name, dow, n, make_date(y, m, 1) AS first_day FROM hol_years,
    (VALUES ('Martin Luther King Jr. Day', 1, 1, 3), ('Washington''s Birthday', 2, 1, 3),
            ('Memorial Day', 5, 1, -1), ('Labor Day', 9, 1, 1), ('Columbus Day', 10, 1, 2),
            ('Thanksgiving', 11, 4, 4)) AS f(name, m, dow, n)),
hol_days AS (
  SELECT name, n, d::DATE AS ds, row_number() OVER (PARTITION BY name, first_day ORDER BY d) AS k,
         count(*) OVER (PARTITION BY name, first_day) AS total
  FROM (SELECT name, n, dow, first_day,
               unnest(generate_series(first_day::TIMESTAMP, last_day(first_day)::TIMESTAMP, INTERVAL 1 DAY)) AS d
        FROM hol_nth) WHERE isodow(d) = dow),
holidays AS (
  SELECT ds, name AS holiday FROM hol_fixed
  UNION ALL SELECT (ds + INTERVAL (CASE isodow(ds) WHEN 6 THEN -1 ELSE 1 END) DAY)::DATE, name || ' (Observed)'
            FROM hol_fixed WHERE isodow(ds) IN (6, 7)
  UNION ALL SELECT ds, name FROM hol_days WHERE (n > 0 AND k = n) OR (n = -1 AND k = total)),
off_days AS (SELECT DISTINCT ds FROM holidays)"""
# forecast frames used by the score queries
NAIVE_HOURLY_SQL = HOURLY_LOAD_SQL + """, naive AS (
  SELECT a.series, a.ts, a.value AS actual, b.value AS pred
  FROM hourly_load a JOIN hourly_load b ON a.series = b.series AND b.ts = a.ts - INTERVAL 7 DAY)"""
NAIVE_DAILY_SQL = DAILY_LOAD_SQL + """, naive AS (
  SELECT a.series, a.ts, a.value AS actual, b.value AS pred
  FROM daily_load a JOIN daily_load b ON a.series = b.series AND b.ts = a.ts - INTERVAL 7 DAY),
bands AS (
  SELECT series, isodow(ts) AS dow, quantile_cont(value, 0.05) AS lower, quantile_cont(value, 0.5) AS mid,
         quantile_cont(value, 0.95) AS upper
  FROM daily_load WHERE year(ts) <> 2000 GROUP BY 1, 2),
banded AS (
  SELECT n.series, n.ts, n.actual, n.pred, b.lower, b.mid, b.upper
  FROM naive n JOIN bands b ON n.series = b.series AND isodow(n.ts) = b.dow WHERE year(n.ts) = 2000)"""

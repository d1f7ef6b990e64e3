"""Calendar, holidays, joins, lags, windows, splits and scaling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hourline.functions import feasts
from hourline.operators import clean, lags, reshape, scale, shapes, splits, windows
from hourline.operators.calendar import calendar_features, holiday_flags, holidays_in
from hourline.operators.segments import RN, SIZE, index_rows
from hourline.plans import workload as w
from hourline.plans.catalog import query, tidy

CALENDAR_SQL = """hour(ts)::BIGINT AS hour_num, (isodow(ts) - 1)::BIGINT AS day_num,
    (isodow(ts) > 5)::INT::BIGINT AS wknd_flag, month(ts)::BIGINT AS month, day(ts)::BIGINT AS day,
    dayofyear(ts)::BIGINT AS day_year, weekofyear(ts)::BIGINT AS week_year, year(ts)::BIGINT AS year"""


@query("calendar_features", f"WITH {w.HOURLY_LOAD_SQL} SELECT series, ts, {CALENDAR_SQL} FROM hourly_load")
def calendar_query(spark, folder):
    return tidy(calendar_features(w.hourly_load(spark, folder).select("series", "ts")))


@query(
    "holiday_table",
    f"""WITH {w.HOLIDAYS_SQL}
    SELECT ds::TIMESTAMP AS ds, holiday FROM holidays
    WHERE year(ds) IN (SELECT DISTINCT year(o_orderdate) FROM orders)""",
)
def holiday_query(spark, folder):
    years = w.table(spark, folder, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return tidy(holidays_in(years))


OFF_SQL = "greatest((isodow(l.ts) > 5)::INT, (o.ds IS NOT NULL)::INT)::BIGINT"


@query(
    "holiday_flags",
    f"""WITH {w.HOLIDAYS_SQL}, {w.DAILY_LOAD_SQL}, shifted AS (
      SELECT series, ts + to_years(y) AS ts FROM daily_load, (SELECT unnest([0, -80, 160]) AS y))
    SELECT l.series, l.ts, (o.ds IS NOT NULL)::INT::BIGINT AS holiday_flag, {OFF_SQL} AS off_flag
    FROM shifted l LEFT JOIN off_days o ON o.ds = l.ts::DATE""",
)
def holiday_flags_query(spark, folder):
    """The days of the load, and the same days 80 years before and 160 years after."""
    load = w.daily_load(spark, folder).select("series", "ts")
    years = F.explode(F.array(*[F.lit(12 * y) for y in (0, -80, 160)]))
    shifted = load.select("series", F.col("ts").alias("_ts"), years.alias("_m"))
    return tidy(holiday_flags(shifted.select("series", F.add_months(F.to_date("_ts"), F.col("_m")).cast("timestamp_ntz").alias("ts"))))


@query(
    "join_weather",
    f"""WITH {w.HOURLY_LOAD_SQL}, {w.HOURLY_WEATHER_SQL}
    SELECT l.series, l.ts, l.value, x.drybulb, x.humidity FROM hourly_load l JOIN hourly_weather x USING (ts)""",
)
def join_weather(spark, folder):
    return tidy(lags.join_weather(w.hourly_load(spark, folder), w.hourly_weather(spark, folder)))


@query(
    "daily_mean",
    f"""WITH {w.HOURLY_LOAD_SQL}
    SELECT series, date_trunc('day', ts)::TIMESTAMP AS date, round(avg(value), 6) AS daily_mean
    FROM hourly_load GROUP BY 1, 2""",
)
def daily_mean(spark, folder):
    return tidy(lags.daily_mean(w.hourly_load(spark, folder)))


@query(
    "daily_mean_attach",
    f"""WITH {w.HOURLY_LOAD_SQL}
    SELECT series, ts, value, round(avg(value) OVER (PARTITION BY series, ts::DATE), 6) AS daily_mean
    FROM hourly_load""",
)
def daily_mean_attach(spark, folder):
    return tidy(lags.daily_mean_attach(w.hourly_load(spark, folder)))


@query(
    "calendar_lag",
    f"""WITH {w.HOURLY_LOAD_SQL}
    SELECT l.series, l.ts, l.value, d1.value AS lag_1d, d2.value AS lag_2d, d7.value AS lag_7d
    FROM hourly_load l
    LEFT JOIN hourly_load d1 ON d1.series = l.series AND d1.ts = l.ts - INTERVAL 1 DAY
    LEFT JOIN hourly_load d2 ON d2.series = l.series AND d2.ts = l.ts - INTERVAL 2 DAY
    LEFT JOIN hourly_load d7 ON d7.series = l.series AND d7.ts = l.ts - INTERVAL 7 DAY""",
)
def calendar_lag(spark, folder):
    wanted = {"lag_1d": ("value", 1), "lag_2d": ("value", 2), "lag_7d": ("value", 7)}
    return tidy(lags.calendar_lag(w.hourly_load(spark, folder), wanted))


LAGGED_SQL = f"""{w.HOURLY_LOAD_SQL}, daily AS (
  SELECT series, ts, value, avg(value) OVER (PARTITION BY series, ts::DATE) AS daily_mean FROM hourly_load),
lagged AS (
  SELECT l.series, l.ts, l.value, l.daily_mean, d.value AS prev_day, k.value AS prev_week_day,
         d.daily_mean AS prev_day_mean
  FROM daily l
  LEFT JOIN daily d ON d.series = l.series AND d.ts = l.ts - INTERVAL 1 DAY
  LEFT JOIN daily k ON k.series = l.series AND k.ts = l.ts - INTERVAL 7 DAY)"""


@query(
    "lag_daily_mean",
    f"""WITH {LAGGED_SQL}
    SELECT series, ts, value, round(daily_mean, 6) AS daily_mean, prev_day, prev_week_day,
           round(prev_day_mean, 6) AS prev_day_mean FROM lagged""",
)
def lag_daily_mean(spark, folder):
    return tidy(lags.lag_features(w.hourly_load(spark, folder)))


FEATURES_SQL = f"""{LAGGED_SQL}, {w.HOLIDAYS_SQL}, {w.HOURLY_WEATHER_SQL}, feature_rows AS (
  SELECT l.series, l.ts, l.value, x.drybulb, x.humidity, l.prev_day, l.prev_week_day,
         round(l.prev_day_mean, 6) AS prev_day_mean, hour(l.ts)::BIGINT AS hour_num,
         (isodow(l.ts) - 1)::BIGINT AS day_num, month(l.ts)::BIGINT AS month, day(l.ts)::BIGINT AS day,
         dayofyear(l.ts)::BIGINT AS day_year, weekofyear(l.ts)::BIGINT AS week_year, {OFF_SQL} AS off_flag
  FROM lagged l LEFT JOIN off_days o ON o.ds = l.ts::DATE JOIN hourly_weather x ON x.ts = l.ts
  WHERE l.prev_day IS NOT NULL AND l.prev_week_day IS NOT NULL AND l.prev_day_mean IS NOT NULL)"""


@query("features", f"WITH {FEATURES_SQL} SELECT * EXCLUDE (drybulb, humidity) FROM feature_rows")
def features(spark, folder):
    return tidy(lags.features(w.hourly_load(spark, folder)))


@query(
    "feature_groups",
    f"""WITH {FEATURES_SQL}
    SELECT series, ts, value, drybulb, humidity, prev_day, prev_week_day, prev_day_mean FROM feature_rows""",
)
def feature_groups(spark, folder):
    full = lags.features(w.hourly_load(spark, folder), weather=w.hourly_weather(spark, folder))
    return tidy(lags.feature_groups(full, ["weather", "lag"]))


@query(
    "features_calendar_only",
    f"""WITH {w.HOURLY_LOAD_SQL}, {w.HOLIDAYS_SQL}
    SELECT l.series, l.ts, l.value, hour(l.ts)::BIGINT AS hour_num, (isodow(l.ts) - 1)::BIGINT AS day_num,
           month(l.ts)::BIGINT AS month, day(l.ts)::BIGINT AS day, dayofyear(l.ts)::BIGINT AS day_year,
           weekofyear(l.ts)::BIGINT AS week_year, {OFF_SQL} AS off_flag
    FROM hourly_load l LEFT JOIN off_days o ON o.ds = l.ts::DATE""",
)
def features_calendar_only(spark, folder):
    return tidy(lags.features(w.hourly_load(spark, folder), lag=False))


@query(
    "week_off_hours",
    f"""WITH {w.HOLIDAYS_SQL}, {w.HOURLY_TOTAL_SQL}, flagged AS (
      SELECT l.series, l.ts, l.value, {OFF_SQL} AS off_flag, year(l.ts)::BIGINT AS year,
             weekofyear(l.ts)::BIGINT AS week
      FROM hourly_total l LEFT JOIN off_days o ON o.ds = l.ts::DATE)
    SELECT *, (sum(off_flag) OVER (PARTITION BY series, year, week))::BIGINT AS off_hours FROM flagged""",
)
def week_off_hours(spark, folder):
    return tidy(shapes.week_off_hours(w.hourly_total(spark, folder)))


@query(
    "hour_counter",
    f"""WITH {w.HOURLY_LOAD_SQL}
    SELECT series, ts, value,
           (row_number() OVER (PARTITION BY series, year(ts), weekofyear(ts) ORDER BY ts) - 1)::BIGINT AS idx
    FROM hourly_load""",
)
def hour_counter(spark, folder):
    return tidy(windows.week_counter(w.hourly_load(spark, folder)))


# --- windows ---------------------------------------------------------------------------------

INDEXED_SQL = f"""{w.HOURLY_LOAD_SQL}, indexed AS (
  SELECT series, ts, value, hour(ts)::BIGINT AS hour_num,
         (row_number() OVER (PARTITION BY series ORDER BY ts) - 1)::BIGINT AS rn,
         (count(*) OVER (PARTITION BY series))::BIGINT AS n
  FROM hourly_load)"""


def _explode_window(df, *extra):
    return tidy(df.select("series", "ts", *extra, F.posexplode("window").alias("pos", "_w")).select(
        "series", "ts", *extra, "pos", "_w.*"
    ))


@query(
    "lookback_windows",
    f"""WITH {INDEXED_SQL}
    SELECT a.series, a.ts, (b.rn - a.rn + 24)::BIGINT AS pos, b.value, b.hour_num
    FROM indexed a JOIN indexed b ON a.series = b.series AND b.rn BETWEEN a.rn - 24 AND a.rn - 1
    WHERE a.rn >= 24""",
)
def lookback_windows(spark, folder):
    load = calendar_features(w.hourly_load(spark, folder), only=["hour_num"])
    return _explode_window(windows.lookback(load, ["value", "hour_num"], 24))


@query(
    "lookback_two_weeks",
    f"""WITH {INDEXED_SQL}
    SELECT series, ts, first AS first_value, last AS last_value, round(total, 2) AS total, 336::BIGINT AS steps FROM (
      SELECT series, ts, rn, first_value(value) OVER k AS first, last_value(value) OVER k AS last, sum(value) OVER k AS total
      FROM indexed WINDOW k AS (PARTITION BY series ORDER BY rn ROWS BETWEEN 336 PRECEDING AND 1 PRECEDING)) WHERE rn >= 336""",
)
def lookback_two_weeks(spark, folder):
    """Windows of 336 hours, each reduced to its ends and its sum."""
    frames = windows.lookback(w.hourly_load(spark, folder), ["value"], 336)
    total = F.aggregate("window", F.lit(0.0), lambda t, x: t + x["value"])
    return tidy(
        frames.select(
            "series", "ts", F.get("window", F.lit(0))["value"].alias("first_value"),
            F.get("window", F.lit(335))["value"].alias("last_value"), total.alias("total"), F.size("window").alias("steps"),
        ), 2,
    )


@query(
    "window_target",
    f"""WITH {INDEXED_SQL}
    SELECT a.series, a.ts, t.value AS target, ((b.rn - a.rn + 48) // 6)::BIGINT AS pos, b.value
    FROM indexed a JOIN indexed t ON t.series = a.series AND t.rn = a.rn + 24
    JOIN indexed b ON a.series = b.series AND b.rn BETWEEN a.rn - 48 AND a.rn - 1 AND (b.rn - a.rn + 48) % 6 = 0
    WHERE a.rn >= 48 AND a.rn < a.n - 25""",
)
def window_target(spark, folder):
    frames = windows.window_target(w.hourly_load(spark, folder), ["value"], "value", 48, delay=24, step=6)
    return _explode_window(frames, "target")


@query(
    "window_batches",
    f"""WITH {INDEXED_SQL}
    SELECT series, ts, ((rn - 24) // 168)::BIGINT AS batch_id FROM indexed
    WHERE rn >= 24 AND rn < n - 1 AND (rn - 24) // 168 < greatest((n - 1 - 24 - 1) // 168, 1)""",
)
def window_batches(spark, folder):
    frames = windows.window_target(w.hourly_load(spark, folder), ["value"], "value", 24)
    return tidy(windows.batches(frames, 168, 24).select("series", "ts", "batch_id"))


def _poisson_sql(u, mean):
    """Inverse distribution function of the Poisson law as a sum of threshold tests."""
    tests, k, total = [], 0, math.exp(-mean)
    while mean ** k / math.factorial(k) * math.exp(-mean) > 1e-12:
        tests.append(f"({u} >= {total!r}::DOUBLE)::INT")
        k += 1
        total += mean ** k / math.factorial(k) * math.exp(-mean)
    return " + ".join(tests)


@query(
    "sample_windows",
    f"""WITH {INDEXED_SQL}, u AS (
      SELECT series, ts,
        ('0x' || md5(series || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '|7')[1:12])::BIGINT / {16 ** 12}::DOUBLE AS u
      FROM indexed WHERE rn >= 24)
    SELECT series, ts, unnest(range(1, {_poisson_sql('u', 0.25)} + 1))::BIGINT AS draw, 24::BIGINT AS steps FROM u""",
)
def sample_windows(spark, folder):
    frames = windows.sample_windows(w.hourly_load(spark, folder), ["value"], 24, 0.25, seed=7)
    return tidy(frames.select("series", "ts", "draw", F.size("window").alias("steps")))


_COMPUTUS_SQL = """years AS (SELECT DISTINCT year(ts)::INT AS y FROM daily_load),
moons AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c, (19 * (y % 19) + y // 100 - y // 400 - (y // 100 - (y // 100 + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM years),
weeks AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM moons),
easters AS (SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS easter FROM (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM weeks)),
months AS (SELECT y, m, unnest(generate_series(make_date(y, m, 1)::TIMESTAMP, last_day(make_date(y, m, 1))::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM years, (SELECT unnest([5, 8]) AS m)),
mondays AS (SELECT y, m, min(d) AS first_monday, max(d) AS last_monday FROM months WHERE isodow(d) = 1 GROUP BY 1, 2),
bank AS (
  SELECT make_date(y, 1, 1) AS d FROM years UNION SELECT make_date(y, 12, 25) FROM years UNION SELECT make_date(y, 12, 26) FROM years
  UNION SELECT easter - 2 FROM easters UNION SELECT easter + 1 FROM easters UNION SELECT first_monday FROM mondays WHERE m = 5 UNION SELECT last_monday FROM mondays
  UNION SELECT make_date(y, 1, 1) + (8 - isodow(make_date(y, 1, 1)))::INT FROM years WHERE isodow(make_date(y, 1, 1)) > 5
  UNION SELECT make_date(y, 12, d) + 2 FROM years, (SELECT unnest([25, 26]) AS d) WHERE isodow(make_date(y, 12, d)) > 5),
german AS (
  SELECT make_date(y, m, d) AS d FROM years, (VALUES (1, 1), (5, 1), (10, 3), (12, 25), (12, 26)) AS f(m, d)
  UNION SELECT easter + n FROM easters, (SELECT unnest([-2, 1, 39, 50]) AS n))"""


@query(
    "country_holidays",
    f"""WITH {w.DAILY_LOAD_SQL}, {_COMPUTUS_SQL}
    SELECT series, ts, value, (ts::DATE IN (SELECT d FROM german))::INT::BIGINT AS german, (ts::DATE IN (SELECT d FROM bank))::INT::BIGINT AS bank FROM daily_load""",
)
def country_holidays(spark, folder):
    """The daily load with the German and the English holidays."""
    return tidy(feasts.with_country_flag(feasts.with_country_flag(w.daily_load(spark, folder), "DE", "german"), "GB", "bank"))


def _mixed_sql(value, number):
    return f"((({value} + 1) * ({48271 + 2 * number} + epoch * 7919) % 2147483647 * 69621 + epoch * 40692) % 2147483647)"


@query(
    "shuffled_epochs",
    f"""WITH RECURSIVE {INDEXED_SQL}, sized AS (
      SELECT series, ts, value, rn, count(*) OVER (PARTITION BY series) AS n FROM indexed),
    grid AS (SELECT *, ceil(sqrt(n))::BIGINT AS w FROM sized),
    walk AS (
      SELECT series, ts, value, epoch, n, w, ceil(n / w)::BIGINT AS h, rn::BIGINT AS y, 0 AS k FROM grid, (SELECT unnest([0, 1, 2])::BIGINT AS epoch)
      UNION ALL
      SELECT series, ts, value, epoch, n, w, h, r2 * w + l2, k + 1 FROM (
        SELECT *, (r1 + {_mixed_sql('l2', 3)}) % h AS r2 FROM (
          SELECT *, (l1 + {_mixed_sql('r1', 2)}) % w AS l2 FROM (
            SELECT *, (y // w + {_mixed_sql('l1', 1)}) % h AS r1 FROM (
              SELECT *, (y % w + {_mixed_sql('(y // w)', 0)}) % w AS l1 FROM walk WHERE k = 0 OR y >= n))))
    )
    SELECT series, ts, value, epoch, y // 32 AS batch, y % 32 AS slot FROM walk WHERE k > 0 AND y < n""",
)
def shuffled_epochs(spark, folder):
    """Three epochs of the hourly load in batches of 32, each in an order of its own."""
    return tidy(windows.shuffled_batches(w.hourly_load(spark, folder), 32, 3))


@query(
    "split_by_index",
    f"""WITH {INDEXED_SQL}
    SELECT series, ts, value, rn AS position,
           CASE WHEN rn <= 399 THEN 'train' WHEN rn <= 499 THEN 'val' ELSE 'test' END AS split FROM indexed""",
)
def split_by_index(spark, folder):
    bounds = {"train": (0, 399), "val": (400, 499), "test": (500, None)}
    return tidy(splits.split_by_index(w.hourly_load(spark, folder), bounds).withColumnRenamed(RN, "position"))


@query(
    "split_tail",
    f"""WITH {INDEXED_SQL}
    SELECT series, ts, value, CASE WHEN rn >= n - 100 THEN 'val' ELSE 'train' END AS split FROM indexed""",
)
def split_tail(spark, folder):
    return tidy(splits.split_tail(w.hourly_load(spark, folder), 100))


@query(
    "walk_forward_split",
    f"""WITH {w.HOURLY_LOAD_SQL}, r AS (SELECT series, min(ts) AS f, max(ts) AS l FROM hourly_load GROUP BY 1)
    SELECT series, 'train' AS split, 'encode' AS part, f AS start_ts, l - INTERVAL 96 HOUR AS end_ts FROM r
    UNION ALL SELECT series, 'train', 'predict', l - INTERVAL 95 HOUR, l - INTERVAL 48 HOUR FROM r
    UNION ALL SELECT series, 'val', 'encode', f + INTERVAL 48 HOUR, l - INTERVAL 48 HOUR FROM r
    UNION ALL SELECT series, 'val', 'predict', l - INTERVAL 47 HOUR, l FROM r""",
)
def walk_forward_split(spark, folder):
    return splits.walk_forward(w.hourly_load(spark, folder), 48)


PARTS_SQL = f"""{w.HOURLY_LOAD_SQL}, r AS (SELECT series, min(ts) AS f, max(ts) AS l FROM hourly_load GROUP BY 1),
parts AS (
  SELECT series, 'train' AS split, 'encode' AS part, f AS a, l - INTERVAL 96 HOUR AS b FROM r
  UNION ALL SELECT series, 'train', 'predict', l - INTERVAL 95 HOUR, l - INTERVAL 48 HOUR FROM r
  UNION ALL SELECT series, 'val', 'encode', f + INTERVAL 48 HOUR, l - INTERVAL 48 HOUR FROM r
  UNION ALL SELECT series, 'val', 'predict', l - INTERVAL 47 HOUR, l FROM r),
labelled AS (
  SELECT h.series, h.ts, p.split, p.part, h.value
  FROM hourly_load h JOIN parts p ON p.series = h.series AND h.ts BETWEEN p.a AND p.b)"""


@query("walk_forward_rows", f"WITH {PARTS_SQL} SELECT * FROM labelled")
def walk_forward_rows(spark, folder):
    return tidy(splits.walk_forward_rows(w.hourly_load(spark, folder), 48))


@query(
    "train_test_split",
    f"""WITH {w.DAILY_LOAD_SQL}, t AS (
      SELECT *, row_number() OVER (PARTITION BY series, year(ts) = 2000 ORDER BY ts DESC) AS k FROM daily_load)
    SELECT series, ts, value,
           CASE WHEN year(ts) = 2000 THEN 'test' WHEN k <= 200 THEN 'val' ELSE 'train' END AS split FROM t""",
)
def train_test_split(spark, folder):
    return tidy(splits.train_test_split(w.daily_load(spark, folder), 2000, 200))


@query(
    "context_test_set",
    f"""WITH {w.DAILY_LOAD_SQL}, t AS (
      SELECT *, row_number() OVER (PARTITION BY series, year(ts) = 2000 ORDER BY ts DESC) AS k FROM daily_load)
    SELECT series, ts, value, CASE WHEN year(ts) = 2000 THEN 'test' ELSE 'context' END AS role
    FROM t WHERE year(ts) = 2000 OR k <= 60""",
)
def context_test_set(spark, folder):
    return tidy(splits.context_test_set(w.daily_load(spark, folder), 2000, 60))


def _frames_sql(size, hop):
    return f"""WITH {INDEXED_SQL}, f AS (
      SELECT *, unnest(range(greatest(0, CAST(floor((rn - {size}) / {hop}) AS BIGINT) + 1), rn // {hop} + 1)) AS frame
      FROM indexed)
    SELECT series, frame::BIGINT AS frame, count(*)::BIGINT AS rows, min(ts) AS first_ts,
           min(value) AS min_value, max(value) AS max_value FROM f GROUP BY 1, 2"""


@query("hopping_frames", _frames_sql(96, 24))
def hopping_frames(spark, folder):
    return tidy(windows.hopping_frames(w.hourly_load(spark, folder), 96, 24))


@query("hopping_frames_hourly", _frames_sql(48, 1))
def hopping_frames_hourly(spark, folder):
    return tidy(windows.hopping_frames(w.hourly_load(spark, folder), 48, 1))


@query(
    "first_n",
    f"""WITH {INDEXED_SQL}
    SELECT series, ts, value, 'head' AS side FROM indexed WHERE rn < 168
    UNION ALL SELECT series, ts, value, 'tail' FROM indexed WHERE rn >= n - 24""",
)
def first_n(spark, folder):
    load = w.hourly_load(spark, folder)
    head = windows.first_n(load, 168).withColumn("side", F.lit("head"))
    return tidy(head.unionByName(windows.first_n(load, 24, last=True).withColumn("side", F.lit("tail"))))


@query(
    "first_n_long",
    f"""WITH {w.DAILY_LOAD_SQL}, k AS (
      SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS rn FROM daily_load)
    SELECT series, ts, value FROM k WHERE rn <= 1440""",
)
def first_n_long(spark, folder):
    """The first 1,440 days of each series."""
    return tidy(windows.first_n(w.daily_load(spark, folder), 1440))


# --- scaling and sequences -------------------------------------------------------------------


@query(
    "minmax_scale",
    f"""WITH {w.DAILY_LOAD_SQL}, s AS (
      SELECT series, min(value) AS lo, max(value) AS hi, min(day(ts)) AS dlo, max(day(ts)) AS dhi
      FROM daily_load WHERE year(ts) <> 2000 GROUP BY 1)
    SELECT d.series, d.ts, round((value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS value,
           round((day(ts) - dlo)::DOUBLE / (dhi - dlo), 6) AS day, 0.0::DOUBLE AS hour_num
    FROM daily_load d JOIN s USING (series)""",
)
def minmax_scale(spark, folder):
    load = calendar_features(w.daily_load(spark, folder), only=["day", "hour_num"])
    return tidy(scale.minmax_scale(load, ["value", "day", "hour_num"], F.year("ts") != 2000))


@query("minmax_inverse", f"WITH {w.DAILY_LOAD_SQL} SELECT series, ts, round(value, 3) AS value FROM daily_load")
def minmax_inverse(spark, folder):
    load = w.daily_load(spark, folder)
    scaled = scale.minmax_scale(load, ["value"], F.year("ts") != 2000, keep_state=True)
    return tidy(scale.minmax_inverse(scaled, "value", "value").select("series", "ts", "value"), 3)


@query(
    "center_series",
    f"""WITH {PARTS_SQL}, m AS (SELECT series, split, avg(value) AS m FROM labelled WHERE part = 'encode' GROUP BY 1, 2)
    SELECT l.series, ts, split, part, round(value - m, 6) AS value, round(m, 6) AS encode_mean
    FROM labelled l JOIN m USING (series, split)""",
)
def center_series(spark, folder):
    return tidy(scale.center_series(w.hourly_load(spark, folder), 48))


@query(
    "center_series_log",
    f"""WITH {w.DUP_LOAD_SQL}, r AS (SELECT series, min(ts) AS f, max(ts) AS l FROM dup_load GROUP BY 1),
    parts AS (
      SELECT series, 'train' AS split, 'encode' AS part, f AS a, l - INTERVAL 96 HOUR AS b FROM r
      UNION ALL SELECT series, 'train', 'predict', l - INTERVAL 95 HOUR, l - INTERVAL 48 HOUR FROM r
      UNION ALL SELECT series, 'val', 'encode', f + INTERVAL 48 HOUR, l - INTERVAL 48 HOUR FROM r
      UNION ALL SELECT series, 'val', 'predict', l - INTERVAL 47 HOUR, l FROM r),
    labelled AS (
      SELECT h.series, h.ts, p.split, p.part, ln(1 + coalesce(h.value, 0)) AS value
      FROM dup_load h JOIN parts p ON p.series = h.series AND h.ts BETWEEN p.a AND p.b WHERE h.ord = 1),
    m AS (SELECT series, split, avg(value) AS m FROM labelled WHERE part = 'encode' GROUP BY 1, 2)
    SELECT l.series, ts, split, part, round(value - m, 6) AS value, round(m, 6) AS encode_mean
    FROM labelled l JOIN m USING (series, split)""",
)
def center_series_log(spark, folder):
    """The load with a missing value at hour 1 of each day, which counts as 0."""
    holes = w.dup_load(spark, folder).filter(F.col("ord") == 1).drop("ord")
    return tidy(scale.center_series(holes, 48, log1p=True))


@query(
    "teacher_forcing",
    f"""WITH {PARTS_SQL}, m AS (SELECT series, split, avg(value) AS m FROM labelled WHERE part = 'encode' GROUP BY 1, 2),
    seq AS (
      SELECT l.series, split, ts, value - m AS value,
             row_number() OVER (PARTITION BY l.series, split ORDER BY ts) AS k,
             count(*) OVER (PARTITION BY l.series, split) AS n
      FROM labelled l JOIN m USING (series, split))
    SELECT series, split, (k - 1)::BIGINT AS pos, round(value, 6) AS value FROM seq WHERE k < n""",
)
def teacher_forcing(spark, folder):
    """Encode values then decode values without the last one, as ordered blocks per series and split."""
    keys = ["series", "split"]
    centred = scale.center_series(w.hourly_load(spark, folder), 48)
    indexed = index_rows(centred, keys, "ts").filter(F.col(RN) < F.col(SIZE) - 1).drop(RN, SIZE)
    return tidy(reshape.explode_arrays(reshape.series_arrays(indexed, keys, block=128), keys))


@query(
    "teacher_forcing_arrays",
    f"""WITH {PARTS_SQL}, enc AS (
      SELECT series, split, list(value ORDER BY ts) AS e FROM (
        SELECT *, row_number() OVER (PARTITION BY series, split ORDER BY ts DESC) AS k FROM labelled WHERE part = 'encode')
      WHERE k <= 168 GROUP BY 1, 2),
    dec AS (SELECT series, split, list(value ORDER BY ts) AS d FROM labelled WHERE part = 'predict' GROUP BY 1, 2),
    seq AS (SELECT series, split, list_concat(e, d[:-2]) AS v FROM enc JOIN dec USING (series, split))
    SELECT series, split, unnest(range(0, len(v)))::BIGINT AS pos, unnest(v) AS value FROM seq""",
)
def teacher_forcing_arrays(spark, folder):
    """The last 168 encode steps followed by the decode steps but the last, as one array each."""
    keys = ["series", "split"]
    rows = splits.walk_forward_rows(w.hourly_load(spark, folder), 48)

    def array(part, name):
        cells = F.array_sort(F.collect_list(F.struct("ts", "value")))
        return part.groupBy(*keys).agg(F.transform(cells, lambda c: c["value"]).alias(name))

    encode = windows.first_n(rows.filter("part = 'encode'").drop("part"), 168, keys=keys, last=True)
    both = array(encode, "e").join(array(rows.filter("part = 'predict'"), "d"), keys)
    forced = windows.teacher_forcing(F.col("e"), F.col("d"))
    return tidy(both.select(*keys, F.posexplode(forced).alias("pos", "value")))


@query("drop_first_targets", f"WITH {INDEXED_SQL} SELECT series, ts, value FROM indexed WHERE rn >= 24")
def drop_first_targets(spark, folder):
    """Targets aligned with look-back windows: the windows' own rows."""
    return tidy(windows.lookback(w.hourly_load(spark, folder), ["value"], 24).select("series", "ts", "value"))


@query(
    "scaled_windows_pipeline",
    f"""WITH {w.DAILY_LOAD_SQL}, s AS (
      SELECT series, min(value) AS lo, max(value) AS hi FROM daily_load WHERE year(ts) <> 2000 GROUP BY 1),
    train AS (
      SELECT d.series, d.ts, (value - lo) / (hi - lo) AS value,
             row_number() OVER (PARTITION BY d.series ORDER BY d.ts) - 1 AS rn
      FROM daily_load d JOIN s USING (series) WHERE year(ts) <> 2000)
    SELECT a.series, a.ts, round(a.value, 6) AS target, round(avg(b.value), 6) AS window_mean, count(*)::BIGINT AS steps
    FROM train a JOIN train b ON a.series = b.series AND b.rn BETWEEN a.rn - 14 AND a.rn - 1
    WHERE a.rn >= 14 GROUP BY a.series, a.ts, a.value""",
)
def scaled_windows_pipeline(spark, folder):
    """Split, scale on the training years and cut 14-day windows; the mean of each window is shown."""
    scaled = scale.minmax_scale(w.daily_load(spark, folder), ["value"], F.year("ts") != 2000)
    frames = windows.lookback(clean.other_years(scaled, 2000), ["value"], 14)
    total = F.aggregate("window", F.lit(0.0), lambda t, x: t + x["value"])
    return tidy(
        frames.select(
            "series", "ts", F.col("value").alias("target"), (total / 14).alias("window_mean"),
            F.size("window").alias("steps"),
        )
    )

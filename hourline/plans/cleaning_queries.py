"""Sources, cleaning, filters and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourline.functions.dates import hour_start
from hourline.functions.parse import fix_hour24, fix_thousands, parse_ts
from hourline.operators import clean, reshape, splits
from hourline.operators.calendar import calendar_features
from hourline.plans import workload as w
from hourline.plans.catalog import query, tidy
from hourline.sources import files

SERIES_SCHEMA = "series STRING, ts TIMESTAMP_NTZ, value DOUBLE"


# --- files -----------------------------------------------------------------------------------


@query("scan_series", f"WITH {w.HOURLY_LOAD_SQL} SELECT series, ts, value FROM hourly_load")
def scan_series(spark, folder):
    path = files.work_path(spark, "series")
    load = w.hourly_load(spark, folder).select(F.monotonically_increasing_id().alias("row"), "series", "ts", "value")
    files.write_csv(load, path)
    return tidy(files.read_series(spark, path, "row BIGINT, " + SERIES_SCHEMA, drop_index=True))


@query(
    "scan_positions",
    f"""WITH {w.DIRTY_OBS_SQL}
    SELECT event_id, strptime(date_s, '%Y-%m-%d %H:%M') AS ts, trim(drybulb_s)::BIGINT AS drybulb,
           humidity_s::BIGINT AS humidity
    FROM dirty_obs WHERE kind = 'view' AND regexp_full_match(trim(drybulb_s), '[+-]?[0-9]+')""",
)
def scan_positions(spark, folder):
    """A raw weather file: seventeen positional fields, of which date, kind and two numbers count."""
    raw = w.dirty_obs(spark, folder)
    wanted = {0: "event_id", 5: "date_s", 6: "kind", 10: "drybulb_s", 16: "humidity_s"}
    path = files.work_path(spark, "weather")
    files.write_csv(raw.select(*[F.col(wanted[i]) if i in wanted else F.lit("-").alias(f"c{i}") for i in range(17)]), path)
    obs = files.read_positions(spark, path, wanted, 17).filter(F.col("kind") == "view")
    dated = obs.withColumn("ts", parse_ts(F.col("date_s")))
    good, _ = clean.validate_ints(dated, ["drybulb_s", "humidity_s"], required=["ts"])
    return tidy(
        good.select(
            F.col("event_id").cast("bigint").alias("event_id"), "ts",
            F.col("drybulb_s").alias("drybulb"), F.col("humidity_s").alias("humidity"),
        )
    )


@query("scan_glob", f"WITH {w.HOURLY_LOAD_SQL} SELECT series, ts, value FROM hourly_load")
def scan_glob(spark, folder):
    path = files.work_path(spark, "native")
    files.write_csv(w.hourly_load(spark, folder), path)
    return tidy(files.read_series(spark, f"{path}/part-*.csv", SERIES_SCHEMA))


def _write_profiles(spark, folder, header):
    """Profile files of two widths: 102 fields before mid-January, 103 after."""
    wide = w.profile_wide(spark, folder)
    early = F.to_date("Date", "MM/dd/yyyy") < F.lit("2024-01-16").cast("date")
    path = files.work_path(spark, "profiles")
    for name, rows, extra in (("narrow", wide.filter(early), 4), ("wide", wide.filter(~early), 5)):
        rows.select("*", *[F.lit(0).alias(f"extra_{i}") for i in range(extra)]).write.csv(
            f"{path}/{name}", header=header
        )
    return path


@query(
    "scan_ragged",
    f"""WITH {w.PROFILE_LONG_SQL}
    SELECT "Type", "Date", "Segment", "Load" FROM profile_long WHERE "Load" IS NOT NULL""",
)
def scan_ragged(spark, folder):
    path = _write_profiles(spark, folder, header=True)
    rows = files.read_ragged(spark, f"{path}/*/part-*.csv")
    return tidy(clean.drop_null_rows(reshape.melt_segments(rows)))


@query(
    "file_audit",
    f"""WITH {w.PROFILE_LONG_SQL}
    SELECT CASE WHEN strptime("Date", '%m/%d/%Y') < TIMESTAMP '2024-01-16' THEN 'narrow' ELSE 'wide' END AS folder,
           CASE WHEN strptime("Date", '%m/%d/%Y') < TIMESTAMP '2024-01-16' THEN 102 ELSE 103 END::BIGINT AS n_fields,
           count(*)::BIGINT AS lines
    FROM (SELECT DISTINCT "Type", "Date" FROM profile_long) GROUP BY 1, 2""",
)
def file_audit(spark, folder):
    path = _write_profiles(spark, folder, header=False)
    audit = files.audit_files(spark, f"{path}/*/part-*.csv")
    parts = F.split("file", "/")
    return tidy(
        audit.withColumn("folder", F.element_at(parts, -2))
        .groupBy("folder", "n_fields").agg(F.sum("lines").alias("lines"))
    )


@query("sink_roundtrip", f"WITH {w.HOURLY_LOAD_SQL} SELECT series, ts, value FROM hourly_load")
def sink_roundtrip(spark, folder):
    path = files.work_path(spark, "sink")
    load = w.hourly_load(spark, folder).withColumn("year", F.year("ts"))
    files.write_table(load, path, partition_by=["year"])
    return tidy(spark.read.schema(SERIES_SCHEMA).parquet(path).select("series", "ts", "value"))


@query(
    "profile_table",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c})::BIGINT AS non_null, count(*)::BIGINT AS rows FROM orders"
        for c, t in [
            ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
            ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
        ]
    ),
)
def profile_table(spark, folder):
    return tidy(files.profile_table(w.table(spark, folder, "orders")))


@query(
    "series_range",
    "SELECT event_type AS series, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1",
)
def series_range(spark, folder):
    events = w.table(spark, folder, "events").withColumnRenamed("event_type", "series")
    return splits.series_range(events)


# --- parsing and cleaning --------------------------------------------------------------------


@query(
    "parse_ts",
    f"WITH {w.DIRTY_OBS_SQL} SELECT event_id, strptime(date_s, '%Y-%m-%d %H:%M') AS ts FROM dirty_obs",
)
def parse_ts_query(spark, folder):
    return w.dirty_obs(spark, folder).select("event_id", parse_ts(F.col("date_s")).alias("ts"))


@query(
    "fix_hour24",
    f"""WITH {w.HOURLY_LOAD_SQL}
    SELECT series, ts FROM hourly_load
    UNION ALL SELECT series || ' bad', CASE hour(ts) % 6 WHEN 5 THEN date_trunc('day', ts) + INTERVAL 59 MINUTE END
    FROM hourly_load WHERE hour(ts) <> 0""",
)
def fix_hour24_query(spark, folder):
    """Good clocks, and copies with clocks that don't exist (and 00:59, which does)."""
    dirty = w.dirty_load(spark, folder).select("series", "hour_s")
    clocks = F.array(*[F.lit(c) for c in ("24:30", "99:00", "-5:00", "05:75", "x:00", "00:59")])
    hour = F.substring("hour_s", 12, 2).cast("int")
    bad = dirty.filter(hour != 24).select(
        F.concat("series", F.lit(" bad")).alias("series"),
        F.concat(F.substring("hour_s", 1, 11), F.get(clocks, hour % 6)).alias("hour_s"),
    )
    return dirty.unionByName(bad).select("series", fix_hour24(F.col("hour_s")).alias("ts"))


@query("fix_thousands", f"WITH {w.HOURLY_LOAD_SQL} SELECT series, ts, round(value * 1000, 1) AS value FROM hourly_load")
def fix_thousands_query(spark, folder):
    dirty = w.dirty_load(spark, folder)
    return tidy(
        dirty.select("series", fix_hour24(F.col("hour_s")).alias("ts"), fix_thousands(F.col("value_s")).alias("value"))
    )


def _observations(spark, folder):
    dated = w.dirty_obs(spark, folder).filter(F.col("kind") == "view").withColumn("ts", parse_ts(F.col("date_s")))
    return clean.validate_ints(dated, ["drybulb_s", "humidity_s"], required=["ts"])


@query(
    "weather_clean",
    f"""WITH {w.DIRTY_OBS_SQL}
    SELECT event_id, strptime(date_s, '%Y-%m-%d %H:%M') AS ts, trim(drybulb_s)::BIGINT AS drybulb,
           humidity_s::BIGINT AS humidity
    FROM dirty_obs WHERE kind = 'view' AND regexp_full_match(trim(drybulb_s), '[+-]?[0-9]+')""",
)
def weather_clean(spark, folder):
    good, _ = _observations(spark, folder)
    return tidy(good.select("event_id", "ts", F.col("drybulb_s").alias("drybulb"), F.col("humidity_s").alias("humidity")))


@query(
    "weather_rejects",
    f"""WITH {w.DIRTY_OBS_SQL}
    SELECT event_id, date_s, drybulb_s, 'drybulb_s' AS reason
    FROM dirty_obs WHERE kind = 'view' AND NOT regexp_full_match(trim(drybulb_s), '[+-]?[0-9]+')""",
)
def weather_rejects(spark, folder):
    _, rejects = _observations(spark, folder)
    return rejects.select("event_id", "date_s", "drybulb_s", "reason")


@query(
    "weather_hourly",
    f"""WITH {w.DIRTY_OBS_SQL}
    SELECT date_trunc('hour', strptime(date_s, '%Y-%m-%d %H:%M')) AS ts,
           round(avg(trim(drybulb_s)::BIGINT), 9) AS drybulb, round(avg(humidity_s::BIGINT), 9) AS humidity
    FROM dirty_obs WHERE kind = 'view' AND regexp_full_match(trim(drybulb_s), '[+-]?[0-9]+') GROUP BY 1""",
)
def weather_hourly(spark, folder):
    good, _ = _observations(spark, folder)
    named = good.select("ts", F.col("drybulb_s").alias("drybulb"), F.col("humidity_s").alias("humidity"))
    return tidy(clean.hourly_mean(named, ["drybulb", "humidity"]), 9)


@query("filter_eq", "SELECT event_id, ts, value FROM events WHERE event_type = 'purchase'")
def filter_eq(spark, folder):
    return w.table(spark, folder, "events").filter(F.col("event_type") == "purchase").select("event_id", "ts", "value")


@query("filter_in", "SELECT event_id, event_type, value FROM events WHERE event_type IN ('view', 'signup')")
def filter_in(spark, folder):
    events = w.table(spark, folder, "events")
    return events.filter(F.col("event_type").isin("view", "signup")).select("event_id", "event_type", "value")


@query(
    "split_by_year",
    """SELECT CASE WHEN year(o_orderdate) = 2000 THEN 'test' ELSE 'train' END AS split,
              count(*)::BIGINT AS n, min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts
       FROM orders GROUP BY 1""",
)
def split_by_year(spark, folder):
    orders = w.table(spark, folder, "orders").select("o_orderdate")
    parts = [
        clean.split_by_year(orders, 2000, "o_orderdate").withColumn("split", F.lit("test")),
        clean.other_years(orders, 2000, "o_orderdate").withColumn("split", F.lit("train")),
    ]
    return clean.union_by_name(parts).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first_ts"), F.max("o_orderdate").alias("last_ts")
    )


@query(
    "slice_period",
    """SELECT o_orderkey, o_orderdate FROM orders
       WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-04-01'""",
)
def slice_period(spark, folder):
    orders = w.table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return clean.slice_period(orders, "1996", "1998-03", "o_orderdate")


@query(
    "slice_hours",
    """SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10 05:00:00' AND ts < TIMESTAMP '2024-01-10 08:00:00'""",
)
def slice_hours(spark, folder):
    """A slice with hour labels, both hours included."""
    return clean.slice_period(w.table(spark, folder, "events").select("event_id", "ts"), "2024-01-10 05", "2024-01-10 07")


@query(
    "time_block",
    f"""WITH {w.HOURLY_LOAD_SQL} SELECT series, ts, value FROM hourly_load
    WHERE ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-14 23:00:00'""",
)
def time_block(spark, folder):
    load = w.hourly_load(spark, folder, "2024-01-08 00:00:00", "2024-01-15 00:00:00")
    return tidy(clean.time_block(load, "2024-01-08 00:00:00", "2024-01-14 23:00:00"))


@query(
    "drop_null_rows",
    f"""WITH {w.DUP_LOAD_SQL}
    SELECT series, ts, round(value, 2) AS value, ord::BIGINT AS ord FROM dup_load WHERE value IS NOT NULL""",
)
def drop_null_rows(spark, folder):
    return tidy(clean.drop_null_rows(w.dup_load(spark, folder)), 2)


@query("null_rows", f"WITH {w.DUP_LOAD_SQL} SELECT series, ts, ord::BIGINT AS ord FROM dup_load WHERE value IS NULL")
def null_rows(spark, folder):
    return tidy(clean.null_rows(w.dup_load(spark, folder)).select("series", "ts", "ord"))


@query(
    "common_timestamps",
    f"""WITH {w.HOURLY_LOAD_SQL}
    SELECT series, ts, value FROM hourly_load WHERE ts IN (
      SELECT ts FROM hourly_load GROUP BY ts
      HAVING count(DISTINCT series) = (SELECT count(DISTINCT series) FROM hourly_load))""",
)
def common_timestamps(spark, folder):
    return tidy(reshape.common_timestamps(w.hourly_load(spark, folder)).select("series", "ts", "value"))


@query(
    "fill_zero",
    f"WITH {w.DUP_LOAD_SQL} SELECT series, ts, ord::BIGINT AS ord, round(coalesce(value, 0), 2) AS value FROM dup_load",
)
def fill_zero(spark, folder):
    return tidy(clean.fill_zero(w.dup_load(spark, folder)).select("series", "ts", "ord", "value"), 2)


@query("rescale_units", f"WITH {w.HOURLY_LOAD_SQL} SELECT series, ts, round(value / 1000, 6) AS value FROM hourly_load")
def rescale_units(spark, folder):
    return tidy(clean.rescale_units(w.hourly_load(spark, folder), ["value"]))


@query(
    "project_region",
    "SELECT event_id, ts AS \"hour_end\", value AS \"region_1\" FROM events",
)
def project_region(spark, folder):
    events = w.table(spark, folder, "events").withColumnsRenamed({"ts": "hour_end", "value": "region_1"})
    return events.select("event_id", "hour_end", "region_1")


@query(
    "cast_features",
    f"""WITH {w.HOURLY_WEATHER_SQL}
    SELECT ts, trunc(drybulb)::BIGINT AS drybulb, trunc(humidity)::BIGINT AS humidity,
           hour(ts)::BIGINT AS hour_num, (isodow(ts) - 1)::BIGINT AS day_num FROM hourly_weather""",
)
def cast_features(spark, folder):
    weather = calendar_features(w.hourly_weather(spark, folder), only=["hour_num", "day_num"])
    columns = ["drybulb", "humidity", "hour_num", "day_num"]
    return tidy(clean.cast_columns(weather, {c: "int" for c in columns}).select("ts", *columns))


@query("distinct_hours", "SELECT DISTINCT hour(ts)::BIGINT AS hour FROM events")
def distinct_hours(spark, folder):
    return tidy(w.table(spark, folder, "events").select(F.hour("ts").alias("hour")).distinct())


@query(
    "range_semi",
    f"""WITH {w.HOURLY_LOAD_SQL} SELECT series, ts, value FROM hourly_load
    WHERE ts IN (SELECT unnest(generate_series(TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-15', INTERVAL 1 HOUR)))""",
)
def range_semi(spark, folder):
    load = w.hourly_load(spark, folder, "2024-01-08 00:00:00", "2024-01-15 01:00:00")
    return tidy(clean.range_semi(load, "2024-01-08 00:00:00", "2024-01-15 00:00:00"))


@query(
    "dedupe_ts",
    f"""WITH {w.DUP_LOAD_SQL}
    SELECT series, ts, round(arg_min(value, ord) FILTER (WHERE value IS NOT NULL), 2) AS value
    FROM dup_load GROUP BY 1, 2""",
)
def dedupe_ts(spark, folder):
    return tidy(clean.dedupe_ts(w.dup_load(spark, folder), ["series", "ts"], ["value"], "ord"), 2)


@query(
    "clean_load",
    f"""WITH {w.HOURLY_LOAD_SQL} SELECT series, ts, round(value, 4) AS value FROM hourly_load""",
)
def clean_load(spark, folder):
    """The whole loader: parse, repair hour 24 and separators, scale, collapse duplicates, drop NULLs.

    The raw text doubles the hour 1 of each day; the first copy has no number.
    """
    copies = F.when(F.col("hour_s").endswith(" 01:00"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    raw = w.dirty_load(spark, folder).withColumn("ord", F.explode(copies))
    value = F.when(F.col("ord") == 1, F.lit("*")).otherwise(F.col("value_s"))
    parsed = raw.select("series", fix_hour24(F.col("hour_s")).alias("ts"), fix_thousands(value).alias("value"), "ord")
    scaled = clean.rescale_units(parsed, ["value"])
    return tidy(clean.drop_null_rows(clean.dedupe_ts(scaled, ["series", "ts"], ["value"], "ord")), 4)


@query(
    "union_by_name",
    f"""WITH {w.HOURLY_LOAD_SQL}, {w.DAILY_LOAD_SQL}
    SELECT series, ts, value, NULL::VARCHAR AS grain FROM hourly_load
    UNION ALL SELECT series, ts, value, 'day' FROM daily_load""",
)
def union_by_name(spark, folder):
    daily = w.daily_load(spark, folder).select("value", F.lit("day").alias("grain"), "ts", "series")
    return tidy(clean.union_by_name([w.hourly_load(spark, folder), daily]))


# --- reshape ---------------------------------------------------------------------------------


@query("melt_segments", f'WITH {w.PROFILE_LONG_SQL} SELECT "Type", "Date", "Segment", "Load" FROM profile_long')
def melt_segments(spark, folder):
    return tidy(reshape.melt_segments(w.profile_wide(spark, folder)))


DAYS = [f"2024-01-{d:02d}" for d in range(1, 31)]
DATE_MATRIX_SQL = f"""cells AS (
  SELECT event_type AS page, date_trunc('day', ts)::TIMESTAMP AS ts, round(sum(value), 2) AS value FROM events GROUP BY 1, 2),
days AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS ts)"""


def _date_matrix(spark, folder):
    """A file with one row for each page, one column for each day, and a column that is no day."""
    events = w.table(spark, folder, "events").select(F.col("event_type").alias("page"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    wide = events.groupBy("page").pivot("day", DAYS).agg(F.round(F.sum("value"), 2)).withColumn("total", F.lit(1.5))
    path = files.work_path(spark, "matrix")
    files.write_csv(wide, path)
    return files.read_matrix(spark, f"{path}/part-*.csv", ["page"])


@query(
    "melt_dates",
    f"""WITH {DATE_MATRIX_SQL}
    SELECT p.page, d.ts, c.value FROM (SELECT DISTINCT page FROM cells) p CROSS JOIN days d
    LEFT JOIN cells c ON c.page = p.page AND c.ts = d.ts""",
)
def melt_dates(spark, folder):
    """A matrix with dates as column names becomes a series; empty cells stay as NULL."""
    good, _ = reshape.melt_dates(_date_matrix(spark, folder), ["page"], "yyyy-MM-dd")
    return tidy(good)


@query("melt_date_rejects", "SELECT 'total' AS label, count(DISTINCT event_type)::BIGINT AS cells FROM events")
def melt_date_rejects(spark, folder):
    _, rejects = reshape.melt_dates(_date_matrix(spark, folder), ["page"], "yyyy-MM-dd")
    return rejects.groupBy("label").agg(F.count(F.lit(1)).alias("cells"))


@query(
    "profile_hourly",
    f"""WITH {w.PROFILE_LONG_SQL}
    SELECT "Type", strptime("Date", '%m/%d/%Y') + to_hours((seg // 4 - 1)::INT) AS ts, round(avg("Load"), 9) AS "Load"
    FROM profile_long WHERE "Load" IS NOT NULL GROUP BY 1, 2""",
)
def profile_hourly(spark, folder):
    return tidy(reshape.segments_to_hourly(reshape.melt_segments(w.profile_wide(spark, folder))), 9)


@query(
    "pivot_mean",
    """SELECT date_trunc('hour', ts) AS ts,
      """ + ",\n      ".join(
        f"round(avg(value) FILTER (WHERE event_type = '{k}'), 9) AS \"{k}\""
        for k in ("click", "error", "purchase", "signup", "view")
    ) + " FROM events GROUP BY 1",
)
def pivot_mean(spark, folder):
    events = w.table(spark, folder, "events").withColumn("ts", hour_start(F.col("ts")))
    kinds = ["click", "error", "purchase", "signup", "view"]
    return tidy(reshape.pivot_mean(events, ["ts"], "event_type", kinds, "value"), 9)


@query(
    "long_mean",
    "SELECT event_type AS series, date_trunc('hour', ts) AS ts, round(avg(value), 9) AS value FROM events GROUP BY 1, 2",
)
def long_mean(spark, folder):
    events = w.table(spark, folder, "events").select(
        F.col("event_type").alias("series"), hour_start(F.col("ts")).alias("ts"), "value"
    )
    return tidy(reshape.long_mean(events, ["series"], "ts", "value"), 9)


@query(
    "series_arrays",
    f"""WITH {w.HOURLY_LOAD_SQL}
    SELECT series, (row_number() OVER (PARTITION BY series ORDER BY ts) - 1)::BIGINT AS pos, value FROM hourly_load""",
)
def series_arrays(spark, folder):
    return tidy(reshape.explode_arrays(reshape.series_arrays(w.hourly_load(spark, folder), block=128)))

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hourline.functions.dates import calendar_columns
from hourline.functions.parse import fix_hour24, fix_thousands, parse_ts, segment_hour, strict_int
from hourline.operators import clean, reshape, shapes
from hourline.operators.calendar import holiday_flags, holiday_table
from hourline.sources import files


def first_column(df):
    return [r[0] for r in df.collect()]


def test_strict_int(spark):
    texts = ["", "*", "72s", " 72 ", "1.5", "+5", "-5", None]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    assert first_column(df.select(strict_int(F.col("t")))) == [None, None, None, 72, None, 5, -5, None]


def test_hour_24_rolls_over(spark):
    df = spark.createDataFrame([("12/31/2016 24:00",), ("01/01/2017 01:00",), ("bad",)], "t STRING")
    assert first_column(df.select(fix_hour24(F.col("t")))) == [
        dt.datetime(2017, 1, 1), dt.datetime(2017, 1, 1, 1), None,
    ]


def test_clocks_that_do_not_exist(spark):
    texts = ["99:00", "-5:00", "05:75", "24:30", "24:00", "23:59", "5", "5:", "x:00", ""]
    df = spark.createDataFrame([(f"01/01/2017 {t}",) for t in texts], "t STRING")
    day = dt.datetime(2017, 1, 1)
    assert first_column(df.select(fix_hour24(F.col("t")))) == [
        None, None, None, None, dt.datetime(2017, 1, 2), day.replace(hour=23, minute=59), day.replace(hour=5), None, None, None,
    ]


def test_numbers_and_stamps(spark):
    df = spark.createDataFrame([("1,234,567.5", "2016-02-29 07:51"), ("*", "x")], "n STRING, t STRING")
    assert first_column(df.select(fix_thousands(F.col("n")))) == [1234567.5, None]
    assert first_column(df.select(parse_ts(F.col("t")))) == [dt.datetime(2016, 2, 29, 7, 51), None]


def test_segment_labels_cover_the_day(spark):
    df = spark.createDataFrame([(f"seg_{n}",) for n in range(4, 100)], "s STRING")
    assert first_column(df.select(segment_hour(F.col("s")))) == [h for h in range(24) for _ in range(4)]


def test_rejects_complement_good_rows(spark):
    df = spark.createDataFrame([("1", "2"), ("*", "2"), ("1", "")], "a STRING, b STRING")
    good, rejects = clean.validate_ints(df, ["a", "b"])
    assert [tuple(r) for r in good.collect()] == [(1, 2)]
    assert sorted(r["reason"] for r in rejects.collect()) == ["a", "b"]


def test_dedupe_takes_first_non_null_per_column(frame):
    df = frame(
        [("a", "2016-11-06 01:00:00", None, 5.0, 1), ("a", "2016-11-06 01:00:00", 7.0, None, 2),
         ("a", "2016-11-06 01:00:00", 8.0, 9.0, 3)],
        "series STRING, ts TIMESTAMP_NTZ, x DOUBLE, y DOUBLE, ord INT",
    )
    for rows in (df, df.orderBy(F.col("ord").desc()).repartition(3)):
        out = clean.dedupe_ts(rows, ["series", "ts"], ["x", "y"], "ord").collect()
        assert [(r["x"], r["y"]) for r in out] == [(7.0, 5.0)]


def test_null_handling(spark):
    df = spark.createDataFrame(
        [(1, 1.0), (2, None), (3, float("nan")), (4, float("inf")), (5, -float("inf"))], "k INT, value DOUBLE"
    )
    assert sorted(r["k"] for r in clean.drop_null_rows(df).collect()) == [1, 4, 5]
    assert sorted(r["k"] for r in clean.null_rows(df).collect()) == [2, 3]
    big = clean.DOUBLE_MAX
    assert {r["k"]: r["value"] for r in clean.fill_zero(df).collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: big, 5: -big}


@pytest.mark.parametrize(
    "start,end,first,last",
    [("2012", "2012", "2012-01-01", "2012-12-31"), ("2012-02", "2012-02", "2012-02-01", "2012-02-29"),
     ("2012-12-30", "2013-01-01", "2012-12-30", "2013-01-01"), ("2011", "2012-03", "2011-01-01", "2012-03-31")],
)
def test_partial_dates_include_both_ends(spark, start, end, first, last):
    days = spark.sql("SELECT explode(sequence(date'2010-12-01', date'2014-01-31')) AS d")
    df = days.select(F.col("d").cast("timestamp_ntz").alias("ts"))
    span = clean.slice_period(df, start, end).agg(F.min("ts"), F.max("ts")).first()
    assert [str(v.date()) for v in span] == [first, last]


def test_hour_labels(frame):
    df = frame([(f"2010-01-31 {h:02d}:{m:02d}:00",) for h in range(24) for m in (0, 30)], "ts TIMESTAMP_NTZ")
    span = clean.slice_period(df, "2010-01-31 05", "2010-01-31T07").agg(F.min("ts"), F.max("ts"), F.count("*")).first()
    assert tuple(span) == (dt.datetime(2010, 1, 31, 5), dt.datetime(2010, 1, 31, 7, 30), 6)
    with pytest.raises(ValueError):
        clean.slice_period(df, "2010-01 05", "2010-01 07")


@pytest.mark.parametrize("bounds", [("2024-01-08 00:00:00", "2024-01-15 00:00:00")])
def test_a_range_reaches_the_scan_of_a_derived_series(spark, bounds):
    from hourline.plans import workload

    plan = workload.hourly_load(spark, "/root/testdata/sf0.001", *bounds)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-08T00:00)" in plan and "LessThan(ts,2024-01-15T00:00)" in plan


def test_date_columns_become_stamps(spark, tmp_path):
    (tmp_path / "m.csv").write_text("page,2016-01-01,2016-01-02,total\np,1.5,,9\nq,2,3,9\n")
    good, rejects = reshape.melt_dates(files.read_matrix(spark, str(tmp_path / "m.csv"), ["page"]), ["page"], "yyyy-MM-dd")
    day = dt.datetime(2016, 1, 1)
    assert sorted((tuple(r) for r in good.collect()), key=str) == sorted([("p", day, 1.5), ("p", day.replace(day=2), None), ("q", day, 2.0), ("q", day.replace(day=2), 3.0)], key=str)
    assert {tuple(r) for r in rejects.collect()} == {("p", "total", 9.0), ("q", "total", 9.0)}


def test_year_split_prunes_and_is_complete(spark, tmp_path):
    df = spark.sql("SELECT explode(sequence(date'1999-12-25', date'2001-01-05')) AS d")
    path = str(tmp_path / "t")
    df.select(F.col("d").cast("timestamp_ntz").alias("ts")).write.parquet(path)
    table = spark.read.parquet(path)
    part = clean.split_by_year(table, 2000)
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2000-01-01T00:00), LessThan" in (
        part._jdf.queryExecution().executedPlan().toString()
    )
    assert part.count() == 366 and clean.other_years(table, 2000).count() == table.count() - 366


def test_range_semi_counts_grid_stamps(hourly):
    df = hourly([1.0] * 400, start="2016-12-30 00:00:00")
    assert clean.range_semi(df, "2017-01-01 00:00:00", "2017-01-08 00:00:00").count() == 169
    assert clean.range_semi(df, "2017-01-01 00:00:00", "2017-01-08 00:00:00", step_hours=24).count() == 8
    half = hourly([1.0] * 10, start="2017-01-01 00:30:00")
    assert clean.range_semi(half, "2017-01-01 00:00:00", "2017-01-08 00:00:00").count() == 0


def test_calendar_at_year_ends(frame):
    df = frame([("2012-12-31 23:00:00",), ("2016-12-31 00:00:00",), ("2017-01-01 00:00:00",)], "ts TIMESTAMP_NTZ")
    cols = calendar_columns(F.col("ts"))
    out = [tuple(r) for r in df.select(cols["day_num"], cols["wknd_flag"], cols["day_year"], cols["week_year"]).collect()]
    assert out == [(0, 0, 366, 1), (5, 1, 366, 52), (6, 1, 1, 52)]


def test_holidays(spark):
    table = {(str(r["ds"]), r["holiday"]) for r in holiday_table(spark, 2010, 2017).collect()}
    expected = {
        ("2015-07-03", "Independence Day (Observed)"), ("2015-07-04", "Independence Day"),
        ("2010-07-05", "Independence Day (Observed)"), ("2010-12-31", "New Year's Day (Observed)"),
        ("2016-11-24", "Thanksgiving"), ("2016-05-30", "Memorial Day"), ("2016-09-05", "Labor Day"),
        ("2016-10-10", "Columbus Day"), ("2016-01-18", "Martin Luther King Jr. Day"),
        ("2016-02-15", "Washington's Birthday"), ("2016-11-11", "Veterans Day"),
        ("2016-12-26", "Christmas Day (Observed)"),
    }
    assert expected <= table
    assert len([1 for _, n in table if "Observed" not in n]) == 80
    assert {d[:4] for d, _ in table} == {str(y) for y in range(2010, 2018)}


def test_rules_agree_with_the_table_in_any_year(spark):
    """Every day of some far years, by rule and by table."""
    for first, last in ((1599, 1601), (1948, 1955), (2149, 2156)):
        days = spark.sql(f"SELECT explode(sequence(date'{first}-01-01', date'{last}-12-31')) AS d")
        flagged = holiday_flags(days.select(F.col("d").cast("timestamp_ntz").alias("ts"))).filter("holiday_flag = 1")
        by_rule = {str(r["ts"].date()) for r in flagged.collect()}
        assert by_rule == {str(r["ds"]) for r in holiday_table(spark, first, last).collect()}


def test_weather_with_two_rows_an_hour_doubles_no_load(spark, hourly):
    from hourline.operators.lags import join_weather

    load = hourly([1.0, 2.0])
    weather = load.select("ts", F.lit(10.0).alias("drybulb")).union(load.select("ts", F.lit(20.0).alias("drybulb")))
    assert [tuple(r)[2:] for r in join_weather(load, weather).orderBy("ts").select("series", "ts", "value", "drybulb").collect()] == [(1.0, 15.0), (2.0, 15.0)]


def test_off_flag(frame):
    df = frame([("2016-07-04 05:00:00",), ("2016-07-05 05:00:00",), ("2016-07-09 05:00:00",)], "ts TIMESTAMP_NTZ")
    out = holiday_flags(df).orderBy("ts").collect()
    assert [(r["holiday_flag"], r["off_flag"]) for r in out] == [(1, 1), (0, 0), (0, 1)]


def test_common_timestamps(hourly):
    df = hourly([1.0, 2.0, 3.0]).unionByName(hourly([5.0, 6.0], series="b", start="2024-01-01 01:00:00"))
    out = reshape.common_timestamps(df)
    assert out.count() == 4 and out.select("ts").distinct().count() == 2


def test_complete_weeks(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, None]), (3, [1.0])], "k INT, shape ARRAY<DOUBLE>")
    assert first_column(shapes.complete_weeks(df, 2)) == [1]


def test_ragged_files(spark, tmp_path):
    for width, name in ((102, "narrow"), (103, "wide")):
        header = ",".join(f"h{i}" for i in range(width))
        row = ",".join(["T", "01/02/2012"] + [str(float(i)) for i in range(96)] + ["9"] * (width - 98))
        (tmp_path / f"{name}.csv").write_text(f"{header}\n{row}\n")
    pattern = str(tmp_path / "*.csv")
    rows = files.read_ragged(spark, pattern).collect()
    assert [r["seg_4"] for r in rows] == [0.0, 0.0] and [r["seg_99"] for r in rows] == [95.0, 95.0]
    audit = {r["file"].rsplit("/", 1)[1]: (r["n_fields"], r["lines"]) for r in files.audit_files(spark, pattern).collect()}
    assert audit == {"narrow.csv": (102, 2), "wide.csv": (103, 2)}


def test_load_file_with_text_stamps(spark, tmp_path):
    (tmp_path / "load.csv").write_text("hour_end,region_1\n2016-01-01 01:00:00,7000.5\n2016-01-01 02:00:00,\n")
    df = files.read_load(spark, str(tmp_path / "load.csv"), "hour_end STRING, region_1 DOUBLE")
    scaled = clean.rescale_units(clean.drop_null_rows(df), ["region_1"])
    assert [tuple(r) for r in scaled.collect()] == [(dt.datetime(2016, 1, 1, 1), 7.0005)]


def test_work_paths_are_removed(spark):
    import os

    path = files.work_path(spark, "probe")
    files.write_table(spark.range(3), path)
    assert os.path.exists(path)
    files.remove_path(spark, path)
    assert not os.path.exists(path)


def test_zone_independence(spark, frame):
    """A wall clock inside a clock change of the session zone stays as written."""
    from hourline.functions.dates import hour_start

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
    try:
        df = frame([("2016-03-13 02:30:00",), ("2016-11-06 01:30:00",)], "ts TIMESTAMP_NTZ")
        assert first_column(df.select(hour_start(F.col("ts")))) == [
            dt.datetime(2016, 3, 13, 2), dt.datetime(2016, 11, 6, 1),
        ]
        text = spark.createDataFrame([("2016-03-13 02:30",), ("2016-13-01 02:30",)], "t STRING")
        assert first_column(text.select(parse_ts(F.col("t")))) == [dt.datetime(2016, 3, 13, 2, 30), None]
        stamps = spark.createDataFrame([("03/12/2016 24:00",), ("03/13/2016 02:00",)], "t STRING")
        assert first_column(stamps.select(fix_hour24(F.col("t")))) == [
            dt.datetime(2016, 3, 13), dt.datetime(2016, 3, 13, 2),
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)

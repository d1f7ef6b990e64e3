"""Distributed ordering is exact, bounded, and independent of row order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hourline.operators import distribution, lags, metrics, reshape, splits, windows
from hourline.operators.segments import (
    CHUNK, HALO, RN, SEG, SIZE, attach_raw_totals, attach_series, index_rows, segment_of, with_chunks,
    with_past_days,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """One series with two thirds of the rows over five months, others short, all with gaps."""
    rng = random.Random(3)
    first = dt.datetime(2023, 11, 3)
    rows = []
    for series, hours in (("hot", 3600), ("b", 900), ("c", 800), ("d", 30)):
        for i in range(hours):
            if rng.random() > 0.1:
                rows.append((series, first + dt.timedelta(hours=i), float(rng.randint(1, 500))))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "series STRING, ts TIMESTAMP_NTZ, value DOUBLE")
    return df.repartition(7, "value").persist()


def by_series(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["series"], r["ts"])):
        out.setdefault(r["series"], []).append(r)
    return out


def test_positions_cross_segments(skewed):
    for rows in by_series(index_rows(skewed, ["series"], "ts")).values():
        assert [r[RN] for r in rows] == list(range(len(rows)))
        assert {r[SIZE] for r in rows} == {len(rows)}


def test_no_segment_or_chunk_grows_with_the_series(skewed):
    indexed = index_rows(skewed, ["series"], "ts")
    largest = skewed.groupBy("series", segment_of("ts")).count().agg(F.max("count")).first()[0]
    assert largest <= 64 * 24
    chunks = with_chunks(indexed, 48, 24)
    assert chunks.groupBy("series", CHUNK).count().agg(F.max("count")).first()[0] <= 1024 + 48 + 24
    assert chunks.filter(~F.col(HALO)).count() == skewed.count()
    assert chunks.count() <= skewed.count() * 1.125
    spread = with_past_days(skewed, "ts", 7)
    assert spread.filter(~F.col(HALO)).count() == skewed.count()
    assert spread.groupBy("series", SEG).count().agg(F.max("count")).first()[0] <= 71 * 24


def test_lookback_equals_list_slices(skewed):
    source = by_series(skewed)
    got = by_series(windows.lookback(skewed, ["value"], 48))
    for series, rows in source.items():
        values = [r["value"] for r in rows]
        out = got.get(series, [])
        assert len(out) == max(0, len(values) - 48)
        for k, r in enumerate(out, start=48):
            assert [x["value"] for x in r["window"]] == values[k - 48:k]


def test_calendar_lag_equals_dictionary_lookup(skewed):
    known = {(r["series"], r["ts"]): r["value"] for r in skewed.collect()}
    out = lags.calendar_lag(skewed, {"d1": ("value", 1), "d7": ("value", 7)}).collect()
    assert len(out) == len(known)
    for r in out:
        assert r["d1"] == known.get((r["series"], r["ts"] - dt.timedelta(days=1)))
        assert r["d7"] == known.get((r["series"], r["ts"] - dt.timedelta(days=7)))


def test_order_and_partitioning_do_not_matter(skewed):
    other = skewed.orderBy(F.rand(1)).repartition(3)
    for op in (
        lambda d: windows.window_target(d, ["value"], "value", 24, delay=5).select("series", "ts", "target"),
        lambda d: splits.split_tail(d, 100),
        lambda d: windows.sample_windows(d, ["value"], 24, 0.3, seed=2),
        lambda d: reshape.explode_arrays(reshape.series_arrays(d, block=100)),
    ):
        a, b = op(skewed), op(other)
        assert a.count() == b.count()
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_attach_series_meets_every_row(skewed):
    totals = skewed.groupBy("series").agg(F.sum("value").alias("total"))
    out = attach_series(skewed, totals, ["series"], segment_of("ts"))
    assert out.count() == skewed.count()
    assert out.join(totals.withColumnRenamed("total", "t2"), "series").filter("total <> t2").isEmpty()


def test_raw_totals_keep_rows_without_a_stamp(spark):
    rows = [("a", None, 5.0), ("a", dt.datetime(2024, 1, 1), 1.0), ("a", None, 9.0), ("b", None, 2.0), ("b", dt.datetime(2024, 5, 1), 3.0)]
    df = spark.createDataFrame(rows, "series STRING, ts TIMESTAMP_NTZ, value DOUBLE")
    out = attach_raw_totals(df, ["series"], "ts", mins={"lo": F.col("value")}, maxs={"hi": F.col("value")}).collect()
    assert sorted((r["series"], r["value"], r["lo"], r["hi"], r[SIZE]) for r in out) == [
        ("a", 1.0, 1.0, 9.0, 3), ("a", 5.0, 1.0, 9.0, 3), ("a", 9.0, 1.0, 9.0, 3), ("b", 2.0, 2.0, 3.0, 2), ("b", 3.0, 2.0, 3.0, 2),
    ]
    assert distribution.histogram(df, bins=2).agg(F.sum("n")).first()[0] == 5


def test_histogram_leaves_out_what_is_no_number(spark):
    values = [0.0, 1.0, 2.0, float("nan"), float("inf"), -float("inf"), None]
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), v) for v in values], "series STRING, ts TIMESTAMP_NTZ, value DOUBLE")
    assert [tuple(r) for r in distribution.histogram(df, bins=2).orderBy("bin").collect()] == [("a", 1, 0.0, 1.0, 1), ("a", 2, 1.0, 2.0, 2)]
    assert distribution.histogram_rejects(df, ["value"]).first()["n"] == 4


def test_blocks_partition_the_rows(skewed):
    frame = skewed.withColumn("actual", F.col("value")).withColumn("pred", F.col("value") + 1)
    for r in metrics.mean_of_blocks(metrics.per_block(frame, "mae", 168), "mae").collect():
        size = skewed.filter(F.col("series") == r["series"]).count()
        assert r["steps"] == size // 168
        assert r["mae"] == pytest.approx(1.0)


@pytest.mark.parametrize("drop", [0, 1, 30, 700, 1500, 5000])
def test_trimmed_mean_by_hand(skewed, drop):
    """Many ties, as the values are whole numbers up to 500."""
    got = {r["series"]: r["trimmed_mean"] for r in metrics.trimmed_mean(skewed, "value", drop).collect()}
    for series, rows in by_series(skewed).items():
        kept = sorted(r["value"] for r in rows)[: max(0, len(rows) - drop)]
        if kept:
            assert got[series] == pytest.approx(sum(kept) / len(kept))
        else:
            assert series not in got


def test_trimmed_mean_sorts_no_series(skewed):
    wide = skewed.withColumn("value", F.col("value") + F.rand(3))
    plan = metrics.trimmed_mean(wide, "value", 1500)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
    want = sorted((r["value"] for r in wide.filter("series = 'hot'").collect()), reverse=True)[1500:]
    got = {r["series"]: r["trimmed_mean"] for r in metrics.trimmed_mean(wide, "value", 1500).collect()}
    assert got["hot"] == pytest.approx(sum(want) / len(want))


def test_first_n_ranks_no_whole_series(skewed):
    df = windows.first_n(skewed, 1440)
    assert df.groupBy("series").count().collect() and "WindowGroupLimit" not in df._jdf.queryExecution().executedPlan().toString()
    for series, rows in by_series(windows.first_n(skewed, 1440, last=True)).items():
        assert [r["ts"] for r in rows] == [r["ts"] for r in by_series(skewed)[series]][-1440:]


def test_sampled_windows_are_the_windows_of_drawn_rows(skewed):
    whole = {(r["series"], r["ts"]): [x["value"] for x in r["window"]] for r in windows.lookback(skewed, ["value"], 24).collect()}
    drawn = windows.sample_windows(skewed, ["value"], 24, 0.3, seed=2).collect()
    assert all([x["value"] for x in r["window"]] == whole[r["series"], r["ts"]] for r in drawn)
    assert 0.2 < len(drawn) / len(whole) < 0.4


def test_histogram_counts_every_row(skewed):
    hist = distribution.histogram(skewed, "value", 25, density=True)
    sizes = {r["series"]: r["n"] for r in hist.groupBy("series").agg(F.sum("n").alias("n")).collect()}
    assert sizes == {r["series"]: r["count"] for r in skewed.groupBy("series").count().collect()}
    area = hist.groupBy("series").agg(F.sum(F.col("density") * (F.col("high") - F.col("low"))).alias("a"))
    assert all(r["a"] == pytest.approx(1.0) for r in area.collect())


def test_plan_scans_the_source_once(spark, tmp_path, skewed):
    """Rows and their totals come from one aggregation of the raw table."""
    path = str(tmp_path / "raw")
    skewed.write.parquet(path)
    raw = spark.read.parquet(path)
    load = raw.groupBy("series", "ts").agg(F.sum("value").alias("value")).filter(F.col("value").isNotNull())
    df = index_rows(load, ["series"], "ts")
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final

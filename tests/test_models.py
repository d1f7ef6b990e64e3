import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourline.functions import dtw
from hourline.operators import (
    cv, decompose, linear, metrics, recursive, scale, shapes, spectral, splits, trees, windows,
)
from hourline.sources import files


def values(df, column, *order):
    return [r[column] for r in df.orderBy(*order).collect()]


# --- windows and splits ----------------------------------------------------------------------


@pytest.mark.parametrize("n,expected", [(24 + 10 + 1, 10), (24 + 10 + 2, 10), (24 + 20 + 1, 10), (24 + 20 + 2, 20), (24 + 4, 3)])
def test_batches_leave_out_the_last(hourly, n, expected):
    """Served rows with look-back 24 and batches of 10: a batch needs one more row behind it."""
    frames = windows.window_target(hourly([float(i) for i in range(n)]), ["value"], "value", 24)
    assert windows.batches(frames, 10, 24).count() == expected


def test_window_step_and_delay(hourly):
    out = windows.window_target(hourly([float(i) for i in range(20)]), ["value"], "value", 6, delay=2, step=3)
    first = out.orderBy("ts").first()
    assert [x["value"] for x in first["window"]] == [0.0, 3.0] and first["target"] == 8.0
    assert out.count() == 20 - 2 - 1 - 6
    with pytest.raises(ValueError):
        windows.window_target(hourly([1.0]), ["value"], "value", 5, step=2)


def test_hopping_frames(hourly):
    out = windows.hopping_frames(hourly([float(i) for i in range(100)]), 96, 24).orderBy("frame").collect()
    assert [(r["frame"], r["rows"], r["min_value"], r["max_value"]) for r in out] == [
        (0, 96, 0.0, 95.0), (1, 76, 24.0, 99.0), (2, 52, 48.0, 99.0), (3, 28, 72.0, 99.0), (4, 4, 96.0, 99.0),
    ]


def test_walk_forward_ranges(hourly):
    out = {(r["split"], r["part"]): (r["start_ts"].isoformat(" "), r["end_ts"].isoformat(" "))
           for r in splits.walk_forward(hourly([1.0] * 240), 48).collect()}
    assert out == {
        ("train", "encode"): ("2024-01-01 00:00:00", "2024-01-06 23:00:00"),
        ("train", "predict"): ("2024-01-07 00:00:00", "2024-01-08 23:00:00"),
        ("val", "encode"): ("2024-01-03 00:00:00", "2024-01-08 23:00:00"),
        ("val", "predict"): ("2024-01-09 00:00:00", "2024-01-10 23:00:00"),
    }


def test_splits_are_disjoint_and_complete(hourly):
    df = hourly([float(i) for i in range(800)], start="2015-12-20 00:00:00")
    out = splits.train_test_split(df, 2016, 50)
    assert out.count() == 800 and out.select("ts").distinct().count() == 800
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 288 - 50, "val": 50, "test": 512}


def test_scaling(hourly):
    df = hourly([2.0, 4.0, 6.0, 10.0]).withColumn("flat", F.lit(3.0))
    fit = F.hour("ts") < 3
    scaled = scale.minmax_scale(df, ["value", "flat"], fit)
    assert values(scaled, "value", "ts") == [0.0, 0.5, 1.0, 2.0]
    assert values(scaled, "flat", "ts") == [0.0] * 4
    back = scale.minmax_inverse(scale.minmax_scale(df, ["value"], fit, keep_state=True), "value", "value")
    assert values(back, "value", "ts") == [2.0, 4.0, 6.0, 10.0]


def test_teacher_forcing_expression(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0, 5.0])], "e ARRAY<DOUBLE>, d ARRAY<DOUBLE>")
    assert df.select(windows.teacher_forcing(F.col("e"), F.col("d"))).first()[0] == [1.0, 2.0, 3.0, 4.0]


# --- scores ----------------------------------------------------------------------------------


@pytest.fixture
def scored(spark):
    rows = [("a", 1, 10.0, 8.0), ("a", 2, 0.0, 1.0), ("a", 3, 20.0, 25.0)]
    return spark.createDataFrame(rows, "series STRING, ts INT, actual DOUBLE, pred DOUBLE")


def test_scores_by_hand(scored):
    assert metrics.mae(scored).first()["mae"] == pytest.approx(8 / 3)
    mape = metrics.mape(scored).first()
    assert mape["mape"] == pytest.approx((0.2 + 0.25) / 2) and mape["n_zero"] == 1
    assert metrics.accuracy(scored).first()["accuracy"] == pytest.approx(1 - (8 / 3) / 10)
    assert metrics.r2(scored).first()["r2"] == pytest.approx(1 - 30 / 200)
    assert metrics.pinball(scored, 0.9).first()["pinball"] == pytest.approx((1.8 + 0.1 + 0.5) / 3)
    assert metrics.quantile_score(scored, 0.9).first()["quantile_score"] == pytest.approx(1 / 2.4)
    band = scored.withColumn("lower", F.lit(5.0)).withColumn("upper", F.lit(15.0))
    assert tuple(metrics.interval_breaches(band).first())[1:] == (1, pytest.approx(1 / 3), 1, pytest.approx(1 / 3))


def test_scores_leave_out_rows_without_a_forecast(spark):
    rows = [("a", 1, 10.0, 9.0), ("a", 2, 100.0, None), ("b", 1, None, 3.0)]
    df = spark.createDataFrame(rows, "series STRING, ts INT, actual DOUBLE, pred DOUBLE")
    assert {tuple(r) for r in metrics.accuracy(df).collect()} == {("a", 0.9, 1), ("b", None, 1)}
    assert {tuple(r) for r in metrics.r2(df).collect()} == {("a", None, 1), ("b", None, 1)}


def test_joins_lose_no_key(spark):
    a = spark.createDataFrame([("s", t, float(t)) for t in range(6)], "series STRING, ts INT, actual DOUBLE")
    p, q = (spark.createDataFrame([("s", t, 1.0) for t in ts], "series STRING, ts INT, pred DOUBLE") for ts in (range(2, 6), range(4, 8)))
    assert metrics.compare_forecasts(a, {"p": p, "q": q}).count() == 8
    assert metrics.interval_table(a.withColumn("pred", F.lit(0.0)), p, q).count() == 8


def test_alignment_refuses_missing_rows(scored):
    ok = metrics.align(scored.drop("pred"), scored.drop("actual"), ["series", "ts"])
    assert ok.count() == 3
    with pytest.raises(Exception, match="keys differ"):
        metrics.align(scored.drop("pred"), scored.drop("actual").limit(2), ["series", "ts"]).collect()


# --- spectral --------------------------------------------------------------------------------


def brute_fourier(x, n_predict, n_harm, detrend):
    n = len(x)
    t = np.arange(n)
    slope = np.polyfit(t, x, 1)[0] if detrend else 0.0
    spectrum = np.fft.fft(x - slope * t)
    keep = np.abs(np.fft.fftfreq(n) * n).round() <= n_harm
    tt = np.arange(n + n_predict)
    waves = [(spectrum[k] * np.exp(2j * np.pi * np.fft.fftfreq(n)[k] * tt)).real / n for k in np.flatnonzero(keep)]
    return np.sum(waves, axis=0) + slope * tt


@pytest.mark.parametrize("detrend", [True, False])
def test_fourier_matches_transform(hourly, detrend):
    x = [0.3 * i + 5 * math.sin(2 * math.pi * 2 * i / 101) + 2 * math.cos(2 * math.pi * 5 * i / 101) for i in range(101)]
    out = spectral.fourier_extrapolate(hourly(x), 30, n_harm=5, detrend=detrend)
    assert np.allclose(values(out, "value", "pos"), brute_fourier(np.array(x), 30, 5, detrend), atol=1e-8)


@pytest.mark.parametrize("n,n_harm", [(1, 3), (2, 3), (4, 3), (5, 3), (6, 3), (7, 3), (8, 3), (9, 20)])
def test_fourier_of_short_series(hourly, n, n_harm):
    x = [1.0, 5.0, 2.0, 9.0, 4.0, 4.0, 7.0, 0.0, 3.0][:n]
    out = spectral.fourier_extrapolate(hourly(x), 5, n_harm=n_harm, detrend=False)
    want = brute_fourier(np.array(x), 5, n_harm, False)
    assert np.allclose(values(out, "value", "pos"), want, atol=1e-9)
    if 2 * n_harm + 1 >= n:
        assert np.allclose(want[:n], x)


def test_missing_values_leave_the_series_first(hourly):
    x = [math.sin(i / 3) + i / 50 for i in range(200)]
    holes = hourly([None if i % 10 == 3 else v for i, v in enumerate(x)])
    whole = hourly([v for i, v in enumerate(x) if i % 10 != 3])
    for op in (lambda d: spectral.acf(d, 6), lambda d: spectral.pacf(d, 6)):
        a, b = ([r[2] for r in op(d).orderBy("lag").collect()] for d in (holes, whole))
        assert np.allclose(a, b)
    a, b = (values(spectral.fourier_extrapolate(d, 4, n_harm=3), "value", "pos") for d in (holes, whole))
    assert np.allclose(a, b)


def test_correlations(hourly):
    rng = np.random.default_rng(1)
    x = [0.0]
    for e in rng.normal(size=3000):
        x.append(0.7 * x[-1] + float(e))
    df = hourly(x)
    d = np.array(x) - np.mean(x)
    want = [float((d[: len(d) - k] * d[k:]).sum() / (d * d).sum()) for k in range(13)]
    assert np.allclose(values(spectral.acf(df, 12), "acf", "lag"), want)
    # brute force partial correlations: solve the Yule-Walker system of each order
    pacf = values(spectral.pacf(df, 12), "pacf", "lag")
    for k in range(1, 13):
        toeplitz = np.array([[want[abs(i - j)] for j in range(k)] for i in range(k)])
        assert pacf[k] == pytest.approx(np.linalg.solve(toeplitz, want[1:k + 1])[-1])


# --- linear models ---------------------------------------------------------------------------


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 4))
    y = x @ np.array([1.0, -2.0, 0.5, 3.0]) + rng.normal(size=500)
    rows = [("a", [1.0, *map(float, r)], float(v)) for r, v in zip(x, y)]
    df = spark.createDataFrame(rows, "series STRING, x ARRAY<DOUBLE>, y DOUBLE").repartition(5)
    fit = linear.solve(linear.cross_products(df, ["series"]), ["series"], [0.0, 2.0, 2.0, 2.0, 2.0]).first()
    design = np.c_[np.ones(500), x]
    want = np.linalg.solve(design.T @ design + np.diag([0, 2, 2, 2, 2]), design.T @ y)
    assert np.allclose(fit["coef"], want)
    assert fit["rss"] == pytest.approx(((y - design @ want) ** 2).sum()) and fit["n"] == 500


def test_few_arrays_leave_the_fit(spark):
    rows = spark.range(20000).selectExpr("concat('s', id % 3) AS series", "array(1.0D, CAST(id % 7 AS DOUBLE)) AS x", "CAST(id % 11 AS DOUBLE) AS y")
    products = linear.cross_products(rows.repartition(256), ["series"])
    assert products.count() <= 3 * linear.PARTS
    total = np.sum([r["part"] for r in products.filter("series = 's1'").collect()], axis=0)
    m = np.array([[1.0, i % 7, i % 11] for i in range(20000) if i % 3 == 1])
    assert np.allclose(total, (m.T @ m)[np.triu_indices(3)])


def test_missing_values_do_not_stop_a_fit(hourly):
    x = [math.sin(2 * math.pi * i / 12) for i in range(200)]
    holes = hourly([None if i in (50, 90) else v for i, v in enumerate(x)])
    out = values(recursive.recursive_forecast(holes, 2, 12), "pred", "step")
    assert np.allclose(out, [math.sin(2 * math.pi * i / 12) for i in range(200, 212)], atol=1e-6)
    last = recursive.recursive_forecast(hourly([*x, None]), 2, 3)
    assert values(last, "pred", "step") == [None] * 3


def test_recursive_forecast_repeats_a_cycle(hourly):
    x = [math.sin(2 * math.pi * i / 12) for i in range(200)]
    out = values(recursive.recursive_forecast(hourly(x), 2, 24), "pred", "step")
    assert np.allclose(out, [math.sin(2 * math.pi * i / 12) for i in range(200, 224)], atol=1e-6)


def test_decomposition_recovers_parts(hourly):
    """Trend, weekly wave and a holiday effect on daily data; also the forecast."""
    n = 900
    holiday = {i for i in range(n) if ((i // 365, i % 365) in {(0, 184), (1, 184), (2, 184)})}
    x = [50 + 0.05 * i + 4 * math.sin(2 * math.pi * i / 7) - (20 if i in holiday else 0) for i in range(n)]
    df = hourly(x, start="2013-01-01 00:00:00", step_hours=24)
    model = decompose.Additive(seasons={"weekly": (7.0, 3)}, noise=0.001)
    out = decompose.decompose(df, model, periods=14, step_hours=24).orderBy("ts").collect()
    assert len(out) == n + 14
    future = [50 + 0.05 * i + 4 * math.sin(2 * math.pi * i / 7) for i in range(n, n + 14)]
    future[-1] -= 20  # Friday 3 July 2015, the observed holiday
    assert np.allclose([r["yhat"] for r in out[n:]], future, atol=0.2)
    assert np.mean([r["value"] - r["yhat"] for r in out[:n]]) == pytest.approx(0, abs=1e-3)
    july4 = out[184]
    assert str(july4["ts"].date()) == "2013-07-04" and july4["holidays"] == pytest.approx(-20, abs=0.5)
    for r in out[:50]:
        assert r["trend"] + r["weekly"] + r["holidays"] == pytest.approx(r["yhat"])
        assert r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"]


def test_cutoffs_and_leakage(hourly):
    df = hourly([float(i % 7) + i / 100 for i in range(200)], step_hours=24)
    spec = dict(initial_hours=100 * 24, period_hours=30 * 24, horizon_hours=10 * 24)
    cuts = values(cv.cutoffs(df, **spec), "cutoff", "cutoff")
    assert [(c - cuts[0]).days for c in cuts] == [0, 30, 60] and (cuts[-1].month, cuts[-1].day) == (7, 8)
    base = decompose.cross_validate(df, model=decompose.Additive(seasons={"weekly": (7.0, 3)}), **spec)
    # changing values after a cutoff must not change the forecasts made at it
    late = F.col("ts") > F.lit(str(cuts[1])).cast("timestamp_ntz")
    changed = df.withColumn("value", F.when(late, F.col("value") * 9).otherwise(F.col("value")))
    again = decompose.cross_validate(changed, model=decompose.Additive(seasons={"weekly": (7.0, 3)}), **spec)
    for frame in ((base, again), (cv.cv_seasonal_naive(df, **spec), cv.cv_seasonal_naive(changed, **spec))):
        a, b = (values(f.filter(F.col("cutoff") <= F.lit(str(cuts[1])).cast("timestamp_ntz")), "pred", "cutoff", "ts") for f in frame)
        assert len(a) == 20 and np.allclose(np.array(a, dtype=float), np.array(b, dtype=float), equal_nan=True)
    assert cv.cutoffs(df, 300 * 24, 24, 24).count() == 0


# --- trees -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tree_data(spark):
    rng = random.Random(11)
    rows = []
    for i in range(2000):
        a, b = rng.random(), rng.random()
        rows.append(("s", i, a, b, 10 * (a > 0.5) + 3 * b + rng.gauss(0, 1), "train" if i % 5 else "test"))
    return spark.createDataFrame(rows, "series STRING, ts INT, a DOUBLE, b DOUBLE, value DOUBLE, split STRING").persist()


def scores(df, split):
    frame = df.filter(F.col("split") == split).withColumnRenamed("value", "actual")
    return metrics.r2(frame).first()["r2"]


def test_trees_learn_and_reload(tree_data, tmp_path):
    model = trees.fit_tree(tree_data, ["a", "b"])
    out = trees.score(model, tree_data)
    assert scores(out, "test") > 0.9
    # every leaf holds at least twenty training rows and predicts their mean
    leaves = out.filter("split = 'train'").groupBy("pred").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    assert all(r["n"] >= 20 and r["m"] == pytest.approx(r["pred"]) for r in leaves.collect())
    files.save_model(model, str(tmp_path / "m"))
    again = trees.score(files.load_model(str(tmp_path / "m")), tree_data)
    assert values(out, "pred", "ts") == values(again, "pred", "ts")
    assert scores(trees.gbt_forecast(tree_data, ["a", "b"], rounds=30), "test") > 0.9


def test_quantile_boosting_stump_by_hand(tree_data):
    """One round with rate 1 and depth 1: the quantile of each side of the split."""
    out = trees.quantile_gbt(tree_data, ["a"], 0.9, rounds=1, rate=1.0, max_depth=1)
    train = out.filter("split = 'train'").groupBy("pred").agg(F.sort_array(F.collect_list("value")).alias("v"))
    for r in train.collect():
        assert r["pred"] == pytest.approx(r["v"][math.ceil(0.9 * len(r["v"])) - 1])


def test_quantile_coverage(tree_data):
    """Six rounds, so that the row state is checkpointed on the way."""
    band = trees.quantile_band(tree_data, ["a", "b"], alpha=0.95, rounds=6, rate=0.5, checkpoint_every=3)
    rows = band.filter("split = 'train'").collect()
    assert len(rows) == 1600
    assert np.mean([r["value"] > r["upper"] for r in rows]) == pytest.approx(0.05, abs=0.02)
    assert np.mean([r["value"] < r["lower"] for r in rows]) == pytest.approx(0.05, abs=0.02)
    assert np.mean([r["value"] < r["mid"] for r in rows]) == pytest.approx(0.5, abs=0.05)


def test_ranks_are_exact(spark):
    rng = random.Random(2)
    groups = {"a": [rng.gauss(0, 1) for _ in range(3000)], "b": [1.0] * 50, "c": [1e9, *[rng.random() for _ in range(200)]], "d": [5.0], "e": [1.0, 1.0, 2.0, 2.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g STRING, r DOUBLE").repartition(6)
    for share in (0.0, 0.1, 0.5, 0.95, 1.0):
        places = {g: max(1, math.ceil(share * len(v))) for g, v in groups.items()}
        assert trees._ranked(rows, places, buckets=16) == {g: sorted(v)[places[g] - 1] for g, v in groups.items()}


def test_quantiles_need_training_rows(tree_data):
    with pytest.raises(ValueError):
        trees.quantile_gbt(tree_data.filter("split = 'test'"), ["a"], 0.5)


# --- shapes ----------------------------------------------------------------------------------


def warping_paths(n, m, w, at=(0, 0)):
    """All monotone paths of steps from the first pair to the last, inside the band."""
    i, j = at
    if not (i - w <= j < i + w):
        return
    if at == (n - 1, m - 1):
        yield [at]
    for step in ((1, 0), (0, 1), (1, 1)):
        to = (i + step[0], j + step[1])
        if to[0] < n and to[1] < m:
            for rest in warping_paths(n, m, w, to):
                yield [at, *rest]


def brute_dtw(a, b, w):
    """The cheapest of all warping paths of two short vectors."""
    paths = warping_paths(len(a), len(b), max(w, abs(len(a) - len(b))))
    return math.sqrt(min((sum((a[i] - b[j]) ** 2 for i, j in p) for p in paths), default=math.inf))


@pytest.mark.parametrize("n,m,w", [(7, 7, 4), (8, 8, 2), (7, 6, 1), (6, 7, 1), (5, 5, 1)])
def test_dtw_matches_recursion(spark, n, m, w):
    rng = random.Random(n * m)
    rows = [([rng.random() for _ in range(n)], [rng.random() for _ in range(m)]) for _ in range(8)]
    df = spark.createDataFrame(rows, "shape ARRAY<DOUBLE>, next_shape ARRAY<DOUBLE>")
    for r in shapes.dtw_pairs(df, w=w).collect():
        assert r["dtw"] == pytest.approx(brute_dtw(r["shape"], r["next_shape"], w))


def test_lower_bound_and_identity(spark):
    rng = random.Random(4)
    rows = [([rng.random() for _ in range(24)], [rng.random() for _ in range(24)]) for _ in range(50)]
    df = spark.createDataFrame(rows, "shape ARRAY<DOUBLE>, next_shape ARRAY<DOUBLE>")
    both = shapes.lb_pairs(shapes.dtw_pairs(df)).collect()
    assert all(r["lb"] <= r["dtw"] + 1e-12 for r in both)
    for r in both:
        batch = dtw.keogh_batch(np.array([r["shape"]]), np.array(r["next_shape"]), 5)[0]
        assert r["lb"] == pytest.approx(batch)
    same = shapes.dtw_pairs(df.withColumn("next_shape", F.col("shape"))).collect()
    assert all(r["dtw"] == 0.0 for r in same)


def test_envelope_must_cover_the_band(spark):
    with pytest.raises(ValueError):
        shapes.assign_clusters(spark.createDataFrame([([1.0],)], "shape ARRAY<DOUBLE>"), [[1.0]], w=4, r=1)


def test_shapes_that_cannot_be_compared_have_no_cluster(spark):
    rows = [([1.0, 2.0],), ([9.0, 9.0],), ([1.0],), (None,), ([1.0, None],), ([float("nan"), 1.0],)]
    out = shapes.assign_clusters(spark.createDataFrame(rows, "shape ARRAY<DOUBLE>"), [[1.0, 1.0], [8.0, 8.0]]).collect()
    assert [r["cluster"] for r in out] == [0, 1, None, None, None, None]


def test_kmeans_matches_brute_force(spark):
    rng = random.Random(9)
    rows = [("s", 2015, wk, [rng.gauss(5 * (wk % 3), 1) for _ in range(6)]) for wk in range(24)]
    rows.append(("s", 2016, 1, [100.0 + i for i in range(6)]))  # ends up alone in its cluster
    df = spark.createDataFrame(rows, "series STRING, year INT, week INT, shape ARRAY<DOUBLE>").repartition(4)
    assigned, table = shapes.dtw_kmeans(df, k=4, iters=5)
    centres = shapes.seed_centroids(df, 4)
    points = [r[3] for r in rows]
    for _ in range(5):
        label = [min(range(4), key=lambda c: (brute_dtw(p, centres[c], 4), c)) for p in points]
        moved = [
            list(np.mean([p for p, c in zip(points, label) if c == k], axis=0)) if k in label else centres[k]
            for k in range(4)
        ]
        done, centres = np.allclose(moved, centres), moved
        if done:
            break
    got = {(r["year"], r["week"]): r["cluster"] for r in assigned.collect()}
    assert [got[r[1], r[2]] for r in rows] == label
    assert np.allclose([r["centroid"] for r in table.orderBy("cluster").collect()], centres)
    assert shapes.unassigned(df, assigned).count() == 0

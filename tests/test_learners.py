"""Trees by series, the sequence model, sparse trends, linear quantiles, shuffled epochs, barycentres."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourline.functions import dtw, feasts
from hourline.operators import decompose, distribution, forest, linear, metrics, nearest, quantile_lines, segments, sequence, shapes, windows

# --- trees -------------------------------------------------------------------------------------

SCHEMA = "series STRING, split STRING, value DOUBLE, a DOUBLE, b DOUBLE"


def tree_rows(seed=1, n=160):
    rng = np.random.default_rng(seed)
    rows = []
    for s in ("x", "y"):
        for i in range(n):
            a, b = float(rng.integers(0, 12)), float(rng.integers(0, 5))
            value = (10.0 if (a > 6) == (s == "x") else 2.0) + b + float(rng.normal())
            rows.append((s, "train" if i % 5 else "test", value, None if i % 17 == 0 else a, b))
    return rows


def grown(frame, min_leaf, depth=None):
    """A tree by exhaustive search over all values, as a function of a row; NULL is less than any number."""
    x = frame[["a", "b"]].fillna(-np.inf).to_numpy()
    y = frame["value"].to_numpy()

    def build(rows, left):
        best = None
        for f in range(2):
            for cut in np.unique(x[rows, f])[:-1]:
                low = rows[x[rows, f] <= cut]
                high = rows[x[rows, f] > cut]
                if min(len(low), len(high)) >= min_leaf:
                    fall = y[low].sum() ** 2 / len(low) + y[high].sum() ** 2 / len(high) - y[rows].sum() ** 2 / len(rows)
                    if best is None or fall > best[0] + 1e-9:
                        best = (fall, f, cut, low, high)
        if best is None or best[0] <= 1e-9 or left == 0:
            return y[rows].mean()
        return best[1], best[2], build(best[3], left and left - 1), build(best[4], left and left - 1)

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    tree = build(np.arange(len(y)), depth)
    return lambda row: value(tree, row)


def test_tree_of_each_series_equals_exhaustive_search(spark):
    rows = tree_rows()
    df = spark.createDataFrame([*rows, ("z", "test", 1.0, 1.0, 1.0), (None, "train", 1.0, 1.0, 1.0)], SCHEMA).repartition(5)
    out = forest.tree_by_series(df, ["a", "b"], min_leaf=8, max_bins=40).toPandas()
    whole = pd.DataFrame(rows, columns=["series", "split", "value", "a", "b"])
    for s, own in whole.groupby("series"):
        predict = grown(own[own.split == "train"], 8)
        got = out[out.series == s]
        want = [predict(r) for r in got[["a", "b"]].fillna(-np.inf).to_numpy()]
        assert np.allclose(got["pred"], want)
    assert out[out.series == "z"]["pred"].isna().all() and out[out.series.isna()]["pred"].isna().all()


def test_boosting_by_series(spark, monkeypatch):
    """Against rounds of exhaustive trees; blocks of series and written states change nothing."""
    rows = tree_rows(2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    out = forest.gbt_by_series(df, ["a", "b"], rounds=4, rate=0.3, max_depth=2, min_leaf=10, max_bins=40).orderBy("series", "value").toPandas()
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
    whole = pd.DataFrame(rows, columns=["series", "split", "value", "a", "b"]).sort_values(["series", "value"])
    for s, own in whole.groupby("series"):
        train = own[own.split == "train"].copy()
        points, pred = own[["a", "b"]].fillna(-np.inf).to_numpy(), np.full(len(own), train.value.mean())
        label = train.value.copy()
        fitted = np.full(len(train), train.value.mean())
        for _ in range(4):
            train["value"] = label - fitted
            tree = grown(train, 10, 2)
            fitted = fitted + 0.3 * np.array([tree(r) for r in train[["a", "b"]].fillna(-np.inf).to_numpy()])
            pred = pred + 0.3 * np.array([tree(r) for r in points])
        assert np.allclose(out[out.series == s]["pred"], pred)
    monkeypatch.setattr(forest, "MAX_NODES", 40)
    monkeypatch.setattr(forest, "_WRITE_EVERY", 2)
    again = forest.gbt_by_series(df, ["a", "b"], rounds=4, rate=0.3, max_depth=2, min_leaf=10, max_bins=40).orderBy("series", "value").toPandas()
    assert np.allclose(again["pred"], out["pred"])


def test_band_by_series(spark):
    rng = np.random.default_rng(3)
    rows = [(s, "train", float(rng.normal() * scale + level * 5), float(level), 0.0) for s, scale in (("narrow", 1.0), ("wide", 5.0)) for level in range(4) for _ in range(150)]
    out = forest.band_by_series(spark.createDataFrame(rows, SCHEMA), ["a", "b"], alpha=0.9, rounds=30).toPandas()
    assert (out.lower <= out.upper).all()
    inside = out.assign(ok=(out.value >= out.lower) & (out.value <= out.upper)).groupby("series").ok.mean()
    assert inside.between(0.7, 0.92).all()
    width = (out.upper - out.lower).groupby(out.series).mean()
    assert width["wide"] > 3 * width["narrow"]


def test_model_is_a_table(spark, tmp_path):
    df = spark.createDataFrame(tree_rows(), SCHEMA)
    growth = forest.Growth({"q": 0.5, "m": None}, rounds=3)
    model = forest.fit_forest(df, ["a", "b"], growth)
    model.write.parquet(str(tmp_path / "model"))
    one, two = (forest.score_forest(m, df, ["a", "b"], growth).orderBy("series", "value").toPandas() for m in (model, spark.read.parquet(str(tmp_path / "model"))))
    assert one.equals(two) and sorted(model.select("series").toPandas().series) == ["x", "y"]


def test_no_training_rows(spark):
    df = spark.createDataFrame([("x", "test", 1.0, 1.0, 1.0)], SCHEMA)
    assert forest.tree_by_series(df, ["a", "b"]).first()["pred"] is None


# --- sequence model ----------------------------------------------------------------------------


@pytest.mark.parametrize("quantile", [0.5, 0.9])
def test_gradient_equals_finite_differences(quantile):
    net = sequence.Network(layers=3, filters=3, hidden=4, quantile=quantile)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(5, 20)), rng.normal(size=(5, 6))
    weights = net.start() + rng.normal(size=len(net.start())) * 0.1
    _, slope = sequence.loss_and_gradient(net, weights, x, y)
    for k in range(0, len(weights), 3):
        step = np.zeros_like(weights)
        step[k] = 1e-6
        rise = sequence.loss_and_gradient(net, weights + step, x, y)[0] - sequence.loss_and_gradient(net, weights - step, x, y)[0]
        assert rise / 2e-6 == pytest.approx(slope[k], abs=1e-4)


def test_outputs_see_their_reach_only():
    net = sequence.Network(layers=3, filters=2, hidden=3)
    x = np.random.default_rng(1).normal(size=(1, 30))
    base = sequence.outputs(net, net.start(), x)[0][0]
    for k in range(30):
        moved = x.copy()
        moved[0, k] += 1.0
        changed = np.flatnonzero(~np.isclose(sequence.outputs(net, net.start(), moved)[0][0], base))
        assert len(changed) and changed.min() >= k and changed.max() < k + net.reach


def test_training_in_tasks(spark, hourly):
    series = hourly([float(10 + 3 * np.sin(t / 4)) for t in range(400)], "a").unionByName(hourly([float(50 + 8 * np.sin(t / 4 + 1)) for t in range(300)], "b"))
    net = sequence.Network(layers=4, filters=4, hidden=8, epochs=12, batches=2, rate=0.02)
    rows = sequence.training_sequences(series, 32, 8, 16)
    assert rows.count() == len(range(0, 361, 16)) + len(range(0, 261, 16))
    first = rows.filter("series = 'a' AND first = 16").first()
    want = np.array([10 + 3 * np.sin(t / 4) for t in range(16, 56)])
    assert np.allclose(first["x"], ((want - want[:32].mean()) / want[:32].std())[:-1]) and len(first["y"]) == 8
    whole = [(np.array(r["x"]), np.array(r["y"])) for r in rows.collect()]
    loss, slope, n = sequence.gradient(net, net.start(), rows)
    alone = sequence.loss_and_gradient(net, net.start(), np.stack([x for x, _ in whole]), np.stack([y for _, y in whole]))
    assert loss == pytest.approx(alone[0]) and np.allclose(slope, alone[1]) and n == 8 * len(whole)
    weights, losses = sequence.fit(rows, net, ("series", "first"))
    assert losses[-1] < 0.5 * losses[0]
    ahead = sequence.sequence_forecast(series, 32, 8, 5, 16, net).orderBy("series", "step").collect()
    assert [(r["series"], r["step"]) for r in ahead] == [(s, k) for s in "ab" for k in range(1, 6)]
    tail = np.array([10 + 3 * np.sin(t / 4) for t in range(368, 400)])
    history = list((tail - tail.mean()) / tail.std())
    for k in range(5):
        history.append(sequence.outputs(net, weights, np.array([history[-16:]]))[0][0, -1])
    assert np.allclose([r["pred"] for r in ahead[:5]], tail.mean() + tail.std() * np.array(history[-5:]), rtol=1e-6)


# --- least squares with absolute penalties, quantiles --------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_sparse_solution_meets_its_conditions(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, 12)).cumsum(axis=0)  # closely related columns
    a, b = x.T @ x + 0.01 * np.eye(12), x.T @ (x[:, 2] * 3 + rng.normal(size=40))
    lasso = np.where(np.arange(12) < 3, 0.0, 10.0 ** rng.integers(0, 4))
    coef = linear.sparse_solution(a, b, lasso)
    slope = b - a @ coef
    zero = coef == 0
    assert np.all(np.abs(slope[zero]) <= lasso[zero] + 1e-6 * np.abs(b).max())
    assert np.allclose(slope[~zero], lasso[~zero] * np.sign(coef[~zero]), atol=1e-6 * np.abs(b).max())


def test_trend_paths_widen_and_repeat(hourly):
    rng = np.random.default_rng(4)
    trend = np.abs(np.arange(900) % 300 - 150) / 10
    df = hourly((50 + trend + rng.normal(size=900)).tolist())
    model = decompose.Additive(seasons={"daily": (1.0, 2)}, holidays=False, changepoint_prior_scale=5.0)
    one, two = (decompose.trend_paths(df, model, periods=400, paths=80).orderBy("ts").toPandas() for _ in range(2))
    assert one.equals(two) and len(one) == 400
    width = one.yhat_upper - one.yhat_lower
    assert width[-20:].mean() > 1.3 * width[:20].mean()


def test_quantile_lines(spark, frame):
    rng = np.random.default_rng(5)
    rows = [(s, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00", [1.0, float(i % 7)], level + (i % 7) * 2 + float(rng.exponential())) for s, level in (("a", 0.0), ("b", 40.0)) for i in range(300)]
    df = frame(rows, "series STRING,ts TIMESTAMP_NTZ,x ARRAY<DOUBLE>,y DOUBLE")
    fit = quantile_lines.fit_quantile_lines(df, [0.1, 0.5, 0.9])
    out = quantile_lines.better_changes(df, fit).toPandas()
    assert len(out) == 12 and (np.minimum(out.lower, out.higher) >= out.loss * (1 - 1e-4)).all()
    scored = quantile_lines.predict_quantiles(df, fit, {"low": 0.1, "high": 0.9}).toPandas()
    assert (scored.y <= scored.low).groupby(scored.series).mean().between(0.07, 0.13).all() and (scored.y <= scored.high).groupby(scored.series).mean().between(0.87, 0.93).all()
    only = frame([("a", f"2024-01-01 {i:02d}:00:00", [1.0], float(i * i)) for i in range(11)], "series STRING,ts TIMESTAMP_NTZ,x ARRAY<DOUBLE>,y DOUBLE")
    assert quantile_lines.fit_quantile_lines(only, [0.5]).first()["coef"][0] == pytest.approx(25.0, abs=0.01)


# --- order, shapes, totals -----------------------------------------------------------------------


def test_permutations_of_any_size(spark):
    rows = [(n, p, e) for n in [*range(1, 40), 97, 250] for p in range(n) for e in (0, 1, 7)]
    df = spark.createDataFrame(rows, "n BIGINT, p BIGINT, e BIGINT")
    out = df.withColumn("q", windows.permuted(F.col("p"), F.col("n"), F.col("e"))).toPandas()
    assert all(sorted(g.q) == list(range(n)) for (n, _), g in out.groupby(["n", "e"]))
    orders = out[out.n == 250].sort_values("p").groupby("e").q.apply(tuple)
    assert len(set(orders)) == 3 and np.mean(np.abs(np.diff(orders[1])) == 1) < 0.1


def test_every_row_once_an_epoch(hourly):
    df = hourly([float(i) for i in range(205)])
    out = windows.shuffled_batches(df, 20, 3, first_epoch=4).toPandas()
    assert set(out.epoch) == {4, 5, 6} and (out.groupby("epoch").value.nunique() == 205).all()
    assert (out.groupby(["epoch", "batch"]).size().sort_values().to_numpy() == [5] * 3 + [20] * 30).all()


def warped(a, b, w):
    """The cheapest path between two vectors, by recursion over cells."""
    n, m = len(a), len(b)
    cost = {(-1, -1): 0.0}
    for i in range(n):
        for j in range(max(0, i - w), min(m, i + w)):
            cost[i, j] = (a[i] - b[j]) ** 2 + min(cost.get((i - 1, j - 1), np.inf), cost.get((i - 1, j), np.inf), cost.get((i, j - 1), np.inf))
    i, j, path = n - 1, m - 1, []
    while i >= 0 and j >= 0:
        path.append((i, j))
        i, j = min([(i - 1, j - 1), (i - 1, j), (i, j - 1)], key=lambda c: cost.get(c, np.inf))
    return path


def test_paths_and_barycentres(spark):
    rng = np.random.default_rng(6)
    x, centre = rng.normal(size=(8, 12)).cumsum(axis=1), rng.normal(size=12).cumsum()
    sums, counts = dtw.align_batch(x, centre, 4)
    for r in range(8):
        path = warped(x[r], centre, 4)
        assert np.allclose(counts[r], np.bincount([j for _, j in path], minlength=12))
        assert np.allclose(sums[r], np.bincount([j for _, j in path], [x[r, i] for i, _ in path], minlength=12))
    rows = [("s", 2024, i, v.tolist()) for i, v in enumerate(np.concatenate([rng.normal(size=(20, 12)).cumsum(axis=1), 9 + rng.normal(size=(20, 12)).cumsum(axis=1)]))]
    days = spark.createDataFrame(rows, "series STRING, year INT, week INT, shape ARRAY<DOUBLE>")
    totals = [shapes.dtw_kmeans(days, k=3, iters=n, barycentres=True)[0].agg(F.sum(F.col("dist") ** 2)).first()[0] for n in (1, 2, 4, 40)]
    assert all(b <= a + 1e-9 for a, b in zip(totals, totals[1:]))


def test_trimmed_mean_with_ties(spark):
    rng = np.random.default_rng(7)
    values = {"a": rng.integers(0, 9, 300).astype(float), "b": np.full(50, 3.0), "c": rng.normal(size=40), "d": np.arange(5.0)}
    df = spark.createDataFrame([(s, float(v)) for s, each in values.items() for v in each] + [("a", None)], "series STRING, v DOUBLE").repartition(7)
    got = {r["series"]: r["trimmed_mean"] for r in metrics.trimmed_mean(df, "v", 30).collect()}
    assert got == {s: pytest.approx(np.sort(v)[:-30].mean()) for s, v in values.items() if len(v) > 30}


def test_histogram_limits_need_no_window(spark, hourly):
    df = hourly([float(i) for i in range(50)])
    for out in (distribution.histogram(df), distribution.hist2d(df.withColumn("x", F.col("value") * 2), "x", "value")):
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert segments.attach_raw_totals(df, ["series"], "ts", mins={"lo": F.col("value")}).count() == 50


@pytest.mark.parametrize("capacity,block", [(64, 20_000), (3, 7)])
def test_nearest_shapes_equal_all_pairs(spark, capacity, block):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(90, 9)).cumsum(axis=1), np.repeat(rng.normal(size=(1, 9)), 12, axis=0)])
    days = spark.createDataFrame([("s", 2024, i, v.tolist()) for i, v in enumerate(x)] + [("s", 2025, 0, None)], "series STRING, year INT, week INT, shape ARRAY<DOUBLE>")
    out = nearest.nearest_shapes(days.repartition(4), F.col("week") % 9 == 0, 4, w=2, capacity=capacity, block=block).collect()
    got = {(r["week"], r["rank"]): (r["near_week"], r["dist"]) for r in out}
    asked = [i for i in range(102) if i % 9 == 0]
    assert len(got) == 4 * len(asked) == len(out)
    for i in asked:
        dist = dtw.dtw_batch(np.repeat(x[i : i + 1], len(x), axis=0), x, 2)
        order = [j for j in sorted(range(len(x)), key=lambda j: (dist[j], j)) if j != i][:4]
        assert [got[i, k + 1][0] for k in range(4)] == order and np.allclose([got[i, k + 1][1] for k in range(4)], dist[order])
    assert nearest.nearest_shapes(days.limit(0), F.lit(True), 2).count() == 0
    few = nearest.nearest_shapes(days.filter("week < 3"), F.lit(True), 5, w=2)
    assert few.count() == 6  # fewer neighbours than asked for


# --- running fits, countries ---------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 7, 60])
def test_running_fits_in_blocks(spark, n):
    """Each step's fit has the rows of its own and all later steps, wherever the blocks are cut."""
    rng = np.random.default_rng(n)
    rows = [(s, int(rng.integers(0, n + 3)), [1.0, float(rng.normal())], float(rng.normal())) for s in ("a", "b") for _ in range(5 * n + 10)]
    df = spark.createDataFrame(rows, "series STRING, k INT, x ARRAY<DOUBLE>, y DOUBLE")
    steps = spark.createDataFrame([(s, k) for s in ("a", "b", "none") for k in range(n)], "series STRING, k INT")
    out = linear.solve_running(linear.cross_products(df, ["series", "k"]), ["series"], "k", [0.1, 0.1], steps)
    assert dict(out.dtypes)["k"] == "int"
    got = {(r["series"], r["k"]): r for r in out.collect()}
    assert set(got) == {(s, k) for s in "ab" for k in range(n)}
    for (s, k), r in got.items():
        own = [(x, y) for t, j, x, y in rows if t == s and j >= k]
        x, y = np.array([o[0] for o in own]), np.array([o[1] for o in own])
        want = np.linalg.solve(x.T @ x + 0.1 * np.eye(2), x.T @ y)
        assert np.allclose(r["coef"], want) and r["n"] == len(own) and r["rss"] == pytest.approx(((y - x @ want) ** 2).sum())


def test_country_days(spark):
    from datetime import date, timedelta

    from dateutil.easter import easter

    years = spark.range(1950, 2151).withColumnRenamed("id", "year").withColumn("year", F.col("year").cast("int"))
    found = {(r["year"], r["e"]) for r in years.withColumn("e", feasts.easter(F.col("year"))).collect()}
    assert found == {(y, easter(y)) for y in range(1950, 2151)}
    german, english = ({r["ds"] for r in feasts.country_days(years, c).collect()} for c in ("DE", "GB"))
    want_german, want_english = set(), set()
    for y in range(1950, 2151):
        sunday = easter(y)
        want_german |= {date(y, m, d) for m, d in ((1, 1), (5, 1), (10, 3), (12, 25), (12, 26))} | {sunday + timedelta(n) for n in (-2, 1, 39, 50)}
        mondays = {m: [date(y, m, d) for d in range(1, 32) if date(y, m, d).weekday() == 0] for m in (5, 8)}
        want_english |= {sunday - timedelta(2), sunday + timedelta(1), mondays[5][0], mondays[5][-1], mondays[8][-1], date(y, 1, 1), date(y, 12, 25), date(y, 12, 26)}
        free = date(y, 1, 1)
        while free.weekday() > 4:
            free += timedelta(1)
        want_english.add(free)
        taken = {d for d in (date(y, 12, 25), date(y, 12, 26)) if d.weekday() < 5}
        for d in (date(y, 12, 25), date(y, 12, 26)):
            day = d
            while d.weekday() > 4 and (day.weekday() > 4 or day in taken):
                day += timedelta(1)
            taken.add(day)
        want_english |= taken
    assert german == want_german and english == want_english

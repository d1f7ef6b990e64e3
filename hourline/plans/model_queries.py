"""Forecast models, decomposition, cross-validation and shape clustering."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from hourline.operators import clean, cv, decompose, forest, lags, metrics, nearest, quantile_lines, recursive, segments, sequence, shapes, spectral, splits, trees, windows
from hourline.operators.calendar import calendar_features
from hourline.plans import ridge_sql as rs
from hourline.plans import workload as w
from hourline.plans.catalog import query, tidy
from hourline.sources import files

FEATURES = lags.CALENDAR_GROUP + lags.LAG_GROUP

INDEXED_SQL = f"""{w.HOURLY_LOAD_SQL}, x AS (
  SELECT series, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS t, value,
         count(*) OVER (PARTITION BY series) AS n
  FROM hourly_load)"""


# --- spectral --------------------------------------------------------------------------------

GAPPY_SQL = """SELECT series, ts, value FROM hourly_load WHERE hour(ts) % 7 <> 6
  UNION ALL SELECT series || ' ' || n, ts, value
  FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS k FROM hourly_load), (SELECT unnest([1, 4, 6, 7]) AS n)
  WHERE k <= n"""
GAPPY_INDEXED_SQL = f"""{w.HOURLY_LOAD_SQL}, gappy AS ({GAPPY_SQL}), x AS (
  SELECT series, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS t, value,
         count(*) OVER (PARTITION BY series) AS n
  FROM gappy)"""


@query(
    "fourier_extrapolate",
    f"""WITH {GAPPY_INDEXED_SQL},
    s AS (SELECT series, n, CASE WHEN n > 1 THEN regr_slope(value, t) ELSE 0 END AS slope FROM x GROUP BY 1, 2),
    h AS (SELECT unnest(range(0, 6)) AS k),
    c AS (
      SELECT series, n, slope, k, sum((value - slope * t) * cos(2 * pi() * k * t / n)) AS a,
             sum((value - slope * t) * sin(2 * pi() * k * t / n)) AS b
      FROM x JOIN s USING (series, n) CROSS JOIN h GROUP BY ALL),
    p AS (SELECT series, n, slope, unnest(range(0, n + 72)) AS pos FROM s)
    SELECT series, p.pos::BIGINT AS pos,
           round(sum((CASE WHEN k = 0 OR 2 * k = c.n THEN 1 WHEN 2 * k < c.n THEN 2 ELSE 0 END) / c.n * (a * cos(2 * pi() * k * pos / c.n)
             + b * sin(2 * pi() * k * pos / c.n))) + any_value(p.slope) * pos, 5) AS value
    FROM p JOIN c USING (series) GROUP BY series, pos""",
)
def fourier_extrapolate(spark, folder):
    return tidy(spectral.fourier_extrapolate(gappy_load(spark, folder), 72, n_harm=5), 5)


def gappy_load(spark, folder):
    """The hourly load with a NULL at every seventh hour, and copies cut down to a few points."""
    load = w.hourly_load(spark, folder)
    holes = load.withColumn("value", F.when(F.hour("ts") % 7 != 6, F.col("value")))
    parts = [holes]
    for n in (1, 4, 6, 7):
        parts.append(windows.first_n(load, n).withColumn("series", F.concat("series", F.lit(f" {n}"))))
    return clean.union_by_name(parts)


ACF_SQL = f"""{INDEXED_SQL}, m AS (SELECT series, avg(value) AS m FROM x GROUP BY 1),
d AS (SELECT series, t, value - m AS d FROM x JOIN m USING (series)),
lagged AS (
  SELECT a.series, b.t - a.t AS lag, sum(a.d * b.d) AS s
  FROM d a JOIN d b ON a.series = b.series AND b.t BETWEEN a.t AND a.t + 48 GROUP BY 1, 2),
acf AS (
  SELECT series, lag, s / max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY series) AS acf FROM lagged)"""


@query("acf", f"WITH {ACF_SQL} SELECT series, lag::BIGINT AS lag, round(acf, 6) AS acf FROM acf")
def acf(spark, folder):
    return tidy(spectral.acf(w.hourly_load(spark, folder)))


@query(
    "pacf",
    f"""WITH RECURSIVE {ACF_SQL},
    r AS (SELECT series, list(acf ORDER BY lag) AS rho FROM acf GROUP BY 1),
    dl AS (
      SELECT series, rho, 0 AS k, []::DOUBLE[] AS phi, 1.0::DOUBLE AS pacf FROM r
      UNION ALL
      SELECT series, rho, k + 1,
             list_append(list_transform(range(1, k + 1), lambda j: phi[j] - new * phi[k + 1 - j]), new), new
      FROM (SELECT *, (rho[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * rho[k + 2 - j])), 0))
                    / (1 - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * rho[j + 1])), 0)) AS new
            FROM dl WHERE k < 48))
    SELECT series, k::BIGINT AS lag, round(pacf, 6) AS pacf FROM dl""",
)
def pacf(spark, folder):
    return tidy(spectral.pacf(w.hourly_load(spark, folder)))


# --- trees -----------------------------------------------------------------------------------


def labelled_features(spark, folder):
    """Features of the daily total, year 2000 held out, with a fixed row order for the learners."""
    table = splits.label_year(lags.features(w.daily_total(spark, folder)), 2000)
    return table.repartition("series", F.year("ts")).sortWithinPartitions("series", "ts")


SCORED = ["series", "ts", "split", "value AS actual", "pred"]


@query("tree_forecast")
def tree_forecast(spark, folder):
    return tidy(trees.tree_forecast(labelled_features(spark, folder), FEATURES).selectExpr(*SCORED))


@query("tree_leaves", "SELECT 0::BIGINT AS small_leaves, 0::BIGINT AS off_mean WHERE (SELECT count(*) FROM lineitem) > 0")
def tree_leaves(spark, folder):
    """What must hold of every leaf: at least 20 training rows, and their mean as its forecast."""
    table = labelled_features(spark, folder)
    model = trees.fit_tree(table, FEATURES)
    leaves = trees.score(model, table.filter("split = 'train'")).groupBy("pred").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")
    )
    off = F.abs(F.col("mean") - F.col("pred")) > 1e-6 * F.abs(F.col("mean"))
    return leaves.agg(F.count_if(F.col("n") < 20).alias("small_leaves"), F.count_if(off).alias("off_mean"))


@query("gbt_forecast")
def gbt_forecast(spark, folder):
    return tidy(trees.gbt_forecast(labelled_features(spark, folder), FEATURES).selectExpr(*SCORED))


STUMP_FEATURES = ["day_num", "month", "day", "week_year", "day_year"]


def stump_features(spark, folder):
    """Calendar features of the daily total: few different whole numbers, so every split is tried."""
    table = calendar_features(w.daily_total(spark, folder), only=STUMP_FEATURES)
    return splits.label_year(table, 2000).repartition("series")


STUMP_ROWS_SQL = f"""{w.DAILY_TOTAL_SQL}, rows_0 AS (
  SELECT series, ts, value, year(ts) <> 2000 AS train, (isodow(ts) - 1)::BIGINT AS day_num, month(ts)::BIGINT AS month,
         day(ts)::BIGINT AS day, weekofyear(ts)::BIGINT AS week_year, dayofyear(ts)::BIGINT AS day_year
  FROM daily_total)"""


def _stump_sql(k, target, min_leaf):
    """CTEs: ``best_<k>`` has the feature, value and sides of the best split of ``target`` over rows_<k>."""
    cells = " UNION ALL ".join(
        f"SELECT {i} AS f, {name} AS v, count(*) AS n, sum({target}) AS s FROM rows_{k} WHERE train GROUP BY {name}"
        for i, name in enumerate(STUMP_FEATURES)
    )
    left = "CASE f " + " ".join(f"WHEN {i} THEN {name}" for i, name in enumerate(STUMP_FEATURES)) + " END <= cut"
    return f"""cells_{k} AS ({cells}),
    sums_{k} AS (
      SELECT f, v, sum(n) OVER (PARTITION BY f ORDER BY v) AS n, sum(s) OVER (PARTITION BY f ORDER BY v) AS s,
             sum(n) OVER (PARTITION BY f) AS total, sum(s) OVER (PARTITION BY f) AS whole FROM cells_{k}),
    best_{k} AS (
      SELECT f, v AS cut, s / n AS low, (whole - s) / (total - n) AS high FROM sums_{k}
      WHERE n >= {min_leaf} AND total - n >= {min_leaf}
      ORDER BY s * s / n + (whole - s) * (whole - s) / (total - n) DESC, f, v LIMIT 1),
    placed_{k} AS (SELECT r.*, {left} AS is_low, low, high FROM rows_{k} r, best_{k})"""


STUMP = dict(max_depth=1, max_bins=400)


@query(
    "tree_stump",
    f"""WITH {STUMP_ROWS_SQL}, {_stump_sql(0, 'value', 20)}
    SELECT series, ts, CASE WHEN train THEN 'train' ELSE 'test' END AS split, value AS actual,
           round(CASE WHEN is_low THEN low ELSE high END, 2) AS pred FROM placed_0""",
)
def tree_stump(spark, folder):
    """A tree of one split, which SQL can search for exhaustively."""
    return tidy(trees.tree_forecast(stump_features(spark, folder), STUMP_FEATURES, **STUMP).selectExpr(*SCORED), 2)


def _boosted_sql(rounds):
    """The first tree fits the value; later ones twice the residual, at a tenth."""
    parts = [STUMP_ROWS_SQL, _stump_sql(0, "value", 10)]
    pred = "CASE WHEN is_low THEN low ELSE high END"
    for k in range(1, rounds):
        before = f"{pred} AS p" if k == 1 else f"p + 0.1::DOUBLE * {pred} AS p"
        columns = ", ".join(["series", "ts", "value", "train", *STUMP_FEATURES])
        parts.append(f"rows_{k} AS (SELECT {columns}, {before} FROM placed_{k - 1})")
        parts.append(_stump_sql(k, "2 * (value - p)", 10))
    return f"""WITH {", ".join(parts)}
    SELECT series, ts, CASE WHEN train THEN 'train' ELSE 'test' END AS split, value AS actual,
           round(p + 0.1::DOUBLE * {pred}, 2) AS pred FROM placed_{rounds - 1}"""


@query("gbt_stumps", _boosted_sql(4))
def gbt_stumps(spark, folder):
    """Four boosted trees of one split."""
    out = trees.gbt_forecast(stump_features(spark, folder), STUMP_FEATURES, rounds=4, **STUMP)
    return tidy(out.selectExpr(*SCORED), 2)


@query(
    "quantile_stump",
    f"""WITH {STUMP_ROWS_SQL.replace("rows_0 AS", "raw AS")}, ranked AS (
      SELECT value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM raw WHERE train),
    begin AS (SELECT min(value) AS p FROM ranked WHERE k >= ceil(0.9::DOUBLE * n)),
    rows_0 AS (SELECT raw.*, p FROM raw, begin),
    {_stump_sql(0, "CASE WHEN value > p THEN 0.9::DOUBLE ELSE 0.9::DOUBLE - 1 END", 10)},
    inside AS (
      SELECT is_low, value - p AS r, row_number() OVER (PARTITION BY is_low ORDER BY value - p) AS k, count(*) OVER (PARTITION BY is_low) AS n
      FROM placed_0 WHERE train),
    leaf AS (SELECT is_low, min(r) AS q FROM inside WHERE k >= ceil(0.9::DOUBLE * n) GROUP BY 1)
    SELECT series, ts, CASE WHEN train THEN 'train' ELSE 'test' END AS split, value AS actual, round(p + 0.5::DOUBLE * q, 2) AS pred
    FROM placed_0 JOIN leaf USING (is_low)""",
)
def quantile_stump(spark, folder):
    """One round of quantile boosting with one split."""
    out = trees.quantile_gbt(stump_features(spark, folder), STUMP_FEATURES, 0.9, rounds=1, rate=0.5, **STUMP)
    return tidy(out.selectExpr(*SCORED), 2)


#: The band of the queries below: quantiles 0.01 and 0.99 around the squared-loss forecast.
BAND = dict(alpha=0.99, rounds=100)


def band(spark, folder):
    """Lower, middle and upper forecasts of the hourly load, a model for each series."""
    late = F.col("ts") >= F.lit("2024-01-24 00:00:00").cast("timestamp_ntz")
    table = lags.features(w.hourly_load(spark, folder)).withColumn("split", F.when(late, "test").otherwise("train"))
    return forest.band_by_series(table, FEATURES, **BAND).select("series", "ts", "split", F.col("value").alias("actual"), "lower", "mid", "upper")


@query("quantile_gbt")
def quantile_gbt(spark, folder):
    return tidy(band(spark, folder).drop("mid"))


@query("tree_interval")
def tree_interval(spark, folder):
    """The interval table of the last days: lower, middle, upper and actual."""
    return tidy(band(spark, folder).filter("split = 'test'").drop("split"))


@query("tree_breaches")
def tree_breaches(spark, folder):
    """Breach counts and rates of the band, in the training days and in the last ones."""
    return tidy(metrics.interval_breaches(band(spark, folder), ["series", "split"]))


SERIES_STUMP_FEATURES = ["day_num", "month", "day", "week_year"]


def series_stump_features(spark, folder):
    """Calendar features of the daily load: few different whole numbers, so every split is tried."""
    return splits.label_year(calendar_features(w.daily_load(spark, folder), only=SERIES_STUMP_FEATURES), 2000)


SERIES_ROWS_SQL = f"""{w.DAILY_LOAD_SQL}, raw AS (
  SELECT series, ts, value, year(ts) <> 2000 AS train, (isodow(ts) - 1)::BIGINT AS day_num, month(ts)::BIGINT AS month,
         day(ts)::BIGINT AS day, weekofyear(ts)::BIGINT AS week_year
  FROM daily_load)"""


def _series_stump_sql(k, total, min_leaf):
    """CTEs: ``placed_<k>`` has each row of rows_<k> and the mean ``low`` or ``high`` of its side of its series' best split; ``total`` is the
    sum of gradients of a group of rows."""
    cells = " UNION ALL ".join(
        f"SELECT series, {i} AS f, {name} AS v, {part} FROM rows_{k} WHERE train GROUP BY series, {name}"
        for i, name in enumerate(SERIES_STUMP_FEATURES) for part in [f"count(*) AS n, {total[0]} AS c"]
    )
    left = "CASE f " + " ".join(f"WHEN {i} THEN {name}" for i, name in enumerate(SERIES_STUMP_FEATURES)) + " END <= cut"
    return f"""cells_{k} AS ({cells}),
    sums_{k} AS (
      SELECT series, f, v, n, total, {total[1].format(c='c', n='n')} AS s, {total[1].format(c='every', n='total')} AS whole FROM (
        SELECT series, f, v, sum(n) OVER w AS n, sum(c) OVER w AS c, sum(n) OVER (PARTITION BY series, f) AS total, sum(c) OVER (PARTITION BY series, f) AS every
        FROM cells_{k} WINDOW w AS (PARTITION BY series, f ORDER BY v))),
    best_{k} AS (
      SELECT series, f, v AS cut, s / n AS low, (whole - s) / (total - n) AS high FROM sums_{k}
      WHERE n >= {min_leaf} AND total - n >= {min_leaf}
      QUALIFY row_number() OVER (PARTITION BY series ORDER BY s * s / n + (whole - s) * (whole - s) / (total - n) DESC, f, v) = 1),
    placed_{k} AS (SELECT r.*, {left} AS is_low, low, high FROM rows_{k} r JOIN best_{k} USING (series))"""


def _series_boosted_sql(rounds):
    columns = ", ".join(["series", "ts", "value", "train", *SERIES_STUMP_FEATURES])
    parts = [SERIES_ROWS_SQL, "rows_0 AS (SELECT raw.*, p FROM raw JOIN (SELECT series, avg(value) AS p FROM raw WHERE train GROUP BY 1) USING (series))"]
    for k in range(rounds):
        if k:
            parts.append(f"rows_{k} AS (SELECT {columns}, p + 0.1::DOUBLE * CASE WHEN is_low THEN low ELSE high END AS p FROM placed_{k - 1})")
        parts.append(_series_stump_sql(k, ("sum(value - p)", "{c}"), 10))
    return f"""WITH {", ".join(parts)}
    SELECT series, ts, CASE WHEN train THEN 'train' ELSE 'test' END AS split, value AS actual,
           round(p + 0.1::DOUBLE * CASE WHEN is_low THEN low ELSE high END, 2) AS pred FROM placed_{rounds - 1}"""


@query("series_stumps", _series_boosted_sql(4))
def series_stumps(spark, folder):
    """Four boosted trees of one split for each series."""
    out = forest.gbt_by_series(series_stump_features(spark, folder), SERIES_STUMP_FEATURES, rounds=4, max_depth=1, max_bins=60)
    return tidy(out.selectExpr(*SCORED), 2)


@query(
    "series_quantile_stumps",
    f"""WITH {SERIES_ROWS_SQL}, ranked AS (
      SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY value) AS k, count(*) OVER (PARTITION BY series) AS n FROM raw WHERE train),
    rows_0 AS (SELECT raw.*, p FROM raw JOIN (SELECT series, min(value) AS p FROM ranked WHERE k >= ceil(0.9::DOUBLE * n) GROUP BY 1) USING (series)),
    {_series_stump_sql(0, ("count(*) FILTER (WHERE value <= p)", "(0.9::DOUBLE * {n} - {c})"), 10)},
    inside AS (
      SELECT series, is_low, value - p AS r, row_number() OVER (PARTITION BY series, is_low ORDER BY value - p) AS k, count(*) OVER (PARTITION BY series, is_low) AS n
      FROM placed_0 WHERE train),
    leaf AS (SELECT series, is_low, min(r) AS q FROM inside WHERE k >= ceil(0.9::DOUBLE * n) GROUP BY 1, 2)
    SELECT series, ts, CASE WHEN train THEN 'train' ELSE 'test' END AS split, value AS actual, round(p + 0.5::DOUBLE * q, 2) AS pred
    FROM placed_0 JOIN leaf USING (series, is_low)""",
)
def series_quantile_stumps(spark, folder):
    """One round of quantile boosting with one split for each series."""
    growth = forest.Growth({"pred": 0.9}, rounds=1, rate=0.5, max_depth=1, max_bins=60)
    table = series_stump_features(spark, folder)
    model = forest.fit_forest(table, SERIES_STUMP_FEATURES, growth)
    return tidy(forest.score_forest(model, table, SERIES_STUMP_FEATURES, growth).selectExpr(*SCORED), 2)


@query("series_trees", f"""WITH {w.DAILY_LOAD_SQL} SELECT count(DISTINCT series)::BIGINT AS series, 0::BIGINT AS small_leaves, 0::BIGINT AS off_mean FROM daily_load""")
def series_trees(spark, folder):
    """A tree for each series, as deep as it goes: every leaf has 20 training rows or more, and their mean as its forecast."""
    scored = forest.tree_by_series(series_stump_features(spark, folder), SERIES_STUMP_FEATURES).filter("split = 'train'")
    leaves = scored.groupBy("series", F.round("pred", 6).alias("pred")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    off = F.abs(F.col("mean") - F.col("pred")) > 1e-6 * F.abs(F.col("mean"))
    return leaves.agg(F.count_distinct("series").alias("series"), F.count_if(F.col("n") < 20).alias("small_leaves"), F.count_if(off).alias("off_mean"))


@query("lagged_pipeline")
def lagged_pipeline(spark, folder):
    """Load and weather to scores: features, whole-number casts, split by date, tree, R2 and MAPE by day."""
    table = lags.features(w.hourly_load(spark, folder), weather=w.hourly_weather(spark, folder))
    table = clean.cast_columns(table, {"drybulb": "int", "humidity": "int"})
    late = F.col("ts") >= F.lit("2024-01-24 00:00:00").cast("timestamp_ntz")
    table = table.withColumn("split", F.when(late, "test").otherwise("train"))
    scored = trees.tree_forecast(table, [*FEATURES, *lags.WEATHER_GROUP]).withColumnRenamed("value", "actual").filter("split = 'test'")
    daily = metrics.mean_of_blocks(metrics.per_block(scored, "mape", 24), "mape").withColumnRenamed("mape", "mape_daily")
    first = metrics.cumulative(scored, "mape", [1], 24).select("series", F.col("mape").alias("mape_24h"))
    return tidy(metrics.r2(scored).join(first, "series").join(daily, "series", "left"))


@query(
    "model_roundtrip",
    f"""WITH {w.DAILY_TOTAL_SQL}
    SELECT count(*)::BIGINT AS rows, 0::BIGINT AS changed
    FROM daily_total a JOIN daily_total b ON b.ts = a.ts - INTERVAL 1 DAY JOIN daily_total c ON c.ts = a.ts - INTERVAL 7 DAY""",
)
def model_roundtrip(spark, folder):
    """Save a fitted tree, load it, and count the rows it scores differently."""
    table = labelled_features(spark, folder)
    model = trees.fit_tree(table, FEATURES)
    path = files.work_path(spark, "model")
    files.save_model(model, path)
    again = trees.score(files.load_model(path), trees.score(model, table).withColumnRenamed("pred", "before"))
    return again.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("pred") != F.col("before")).alias("changed")
    )


# --- linear quantiles ------------------------------------------------------------------------

LINES = {"q05": 0.05, "q50": 0.5, "q95": 0.95}


def line_rows(spark, folder):
    """The daily load with a constant, the trend, the weekly and the yearly wave and the weekend, scaled to the series' mean."""
    table = w.daily_load(spark, folder)
    mean = table.groupBy("series").agg(F.avg("value").alias("mean"))
    scaled = segments.attach_series(table, mean, ["series"], segments.segment_of("ts"))
    day = F.unix_date(F.to_date("ts")).cast("double")
    waves = [f(F.lit(2 * pi / period) * day) for period in (7.0, 365.25) for f in (F.cos, F.sin)]
    x = F.array(F.lit(1.0), day / 3650.0 - 2.5, *waves, (F.weekday("ts") > 4).cast("double"))
    return scaled.select("series", "ts", x.alias("x"), (F.col("value") / F.col("mean")).alias("y"), "value", "mean")


@query("quantile_lines")
def quantile_lines_query(spark, folder):
    """Linear forecasts of the 5 %, 50 % and 95 % quantile, for each series."""
    rows = line_rows(spark, folder)
    scored = quantile_lines.predict_quantiles(rows, quantile_lines.fit_quantile_lines(rows, list(LINES.values())), LINES)
    return tidy(scored.select("series", "ts", F.col("value").alias("actual"), *[(F.col(n) * F.col("mean")).alias(n) for n in LINES]))


@query(
    "quantile_lines_best",
    f"""WITH {w.DAILY_LOAD_SQL} SELECT series, q::DOUBLE AS q, 7::BIGINT AS terms, 0::BIGINT AS better
    FROM (SELECT DISTINCT series FROM daily_load), (SELECT unnest([0.05, 0.5, 0.95]) AS q)""",
)
def quantile_lines_best(spark, folder):
    """What must hold of a least pinball loss: no single coefficient's change lowers it, by more than a thousandth."""
    rows = line_rows(spark, folder)
    changes = quantile_lines.better_changes(rows, quantile_lines.fit_quantile_lines(rows, list(LINES.values())))
    better = F.least("lower", "higher") < F.col("loss") * (1 - 1e-3)
    return changes.groupBy("series", "q").agg(F.count(F.lit(1)).alias("terms"), F.count_if(better).alias("better"))


# --- decomposition and cross-validation ------------------------------------------------------

CV = dict(initial_hours=365 * 24, period_hours=100 * 24, horizon_hours=28 * 24)


DAILY_MODEL = decompose.Additive()
HOURLY_MODEL = decompose.Additive(
    seasons={"monthly": (30.5, 3), "weekly": (7.0, 3), "daily": (1.0, 4)}, changepoint_prior_scale=0.001
)


def _decompose_sql(source, name, model, future, digits):
    p = len(model.penalty())
    at, parts = 1, []
    for group, width in model.groups().items():
        parts.append(f"round({rs.dot_sql('x', 'coef', at, width)} * peak, {digits}) AS {group}")
        at += width
    yhat = rs.dot_sql("x", "coef", 1, p)
    return f"""WITH RECURSIVE {source}, {w.HOLIDAYS_SQL}, {rs.NAMED_DAYS_SQL},
    span AS (SELECT series, min(ts) AS f, max(ts) AS l, max(abs(value)) AS peak FROM {name} GROUP BY 1),
    frame AS (
      SELECT series, ts, value FROM {name}
      UNION ALL SELECT series, unnest(generate_series(l + {future[0]}, l + {future[1]}, {future[0]})), NULL FROM span),
    designed AS (
      SELECT fr.series, fr.ts, fr.value, peak, {rs.design_sql(model, 'fr.ts')} AS x
      FROM frame fr JOIN span USING (series) LEFT JOIN named_days d ON d.ds = fr.ts::DATE),
    train AS (SELECT series, list_append(x, value / peak) AS xy FROM designed WHERE value IS NOT NULL),
    {rs.gram_sql('gram', 'train', 'series', p)}, {rs.penalty_sql(model.penalty())},
    cells AS (
      SELECT g.series, g.i, g.j, g.v + CASE WHEN g.i = g.j THEN w ELSE 0 END AS v FROM gram g JOIN penalty USING (i)),
    {rs.solve_sql('fit', 'cells', 'series', p)},
    scored AS (SELECT *, {yhat} * peak AS yhat FROM designed JOIN fit USING (series)),
    spread AS (
      SELECT series, sqrt(avg((value - yhat) ** 2)) AS s FROM scored WHERE value IS NOT NULL GROUP BY 1)
    SELECT series, ts, value, {", ".join(parts)}, round(yhat, {digits}) AS yhat,
           round(yhat - 1.2815515655446004::DOUBLE * s, {digits}) AS yhat_lower,
           round(yhat + 1.2815515655446004::DOUBLE * s, {digits}) AS yhat_upper
    FROM scored JOIN spread USING (series)"""


@query(
    "decompose",
    _decompose_sql(w.DAILY_LOAD_SQL, "daily_load", DAILY_MODEL, ("INTERVAL 1 DAY", "INTERVAL 30 DAY"), 2),
)
def decompose_query(spark, folder):
    return tidy(decompose.decompose(w.daily_load(spark, folder), DAILY_MODEL, periods=30, step_hours=24), 2)


@query(
    "decompose_hourly",
    _decompose_sql(w.HOURLY_LOAD_SQL, "hourly_load", HOURLY_MODEL, ("INTERVAL 1 HOUR", "INTERVAL 168 HOUR"), 4),
)
def decompose_hourly(spark, folder):
    """Hourly load with daily and weekly terms and a 30.5-day term."""
    return tidy(decompose.decompose(w.hourly_load(spark, folder), HOURLY_MODEL, periods=168), 4)


SPARSE_MODEL = decompose.Additive(changepoint_prior_scale=0.05, sparse=True)


@query("sparse_trend")
def sparse_trend(spark, folder):
    """The decomposition with a trend whose changes are mostly exactly zero."""
    return tidy(decompose.decompose(w.daily_load(spark, folder), SPARSE_MODEL, periods=30, step_hours=24), 2)


@query(
    "sparse_trend_conditions",
    f"""WITH {w.DAILY_LOAD_SQL} SELECT series, {len(SPARSE_MODEL.penalty())}::BIGINT AS terms, 0::BIGINT AS off, true AS has_zeros FROM daily_load GROUP BY 1""",
)
def sparse_trend_conditions(spark, folder):
    """What must hold of the least absolute-penalty solution: a term that isn't zero has a gradient of exactly its penalty, a zero one at most that.

    The gradients are summed over the rows, apart from the fit."""
    rows, fit = decompose.fitted(w.daily_load(spark, folder), SPARSE_MODEL)
    path = files.work_path(spark, "design")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    scored = segments.attach_series(rows, fit, ["series"], segments.segment_of("ts"))
    residual = F.col("value") / F.col("_scale") - quantile_lines.dot("x", "coef")
    cells = scored.select("series", "coef", residual.alias("r"), F.posexplode("x").alias("j", "v"))
    penalties = [F.array(*[F.lit(p) for p in each]) for each in (SPARSE_MODEL.penalty(), SPARSE_MODEL.lasso())]
    sums = cells.groupBy("series", "j").agg(F.sum(F.col("r") * F.col("v")).alias("g"), F.first(F.get("coef", F.col("j"))).alias("c"))
    sums = sums.select("series", "c", F.get(penalties[1], F.col("j")).alias("lasso"), (F.col("g") - F.get(penalties[0], F.col("j")) * F.col("c")).alias("g"))
    good = F.when(F.col("c") == 0, F.abs("g") <= F.col("lasso") + 1e-6).otherwise(F.abs(F.col("g") - F.col("lasso") * F.signum("c")) <= 1e-6)
    return sums.groupBy("series").agg(
        F.count(F.lit(1)).alias("terms"), F.count_if(~good).alias("off"), (F.count_if((F.col("c") == 0) & (F.col("lasso") > 0)) > 0).alias("has_zeros")
    )


PATHS = dict(periods=30, paths=60)


def _paths_sql(source, name, model, periods, paths):
    p = len(model.penalty())
    draws = ", ".join(
        f"(('0x' || substr(md5(series || '|' || path || '|' || step || '|{i}'), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u{i}" for i in range(4)
    )
    c = model.changepoints
    return f"""WITH RECURSIVE {source}, {w.HOLIDAYS_SQL}, {rs.NAMED_DAYS_SQL},
    span AS (SELECT series, min(ts) AS f, max(ts) AS l, max(abs(value)) AS peak FROM {name} GROUP BY 1),
    frame AS (
      SELECT series, ts, value, 0 AS step FROM {name}
      UNION ALL SELECT series, l + to_days(k::INT), NULL, k FROM span, (SELECT unnest(range(1, {periods + 1})) AS k)),
    designed AS (
      SELECT fr.series, fr.ts, fr.value, fr.step, peak, {rs.design_sql(model, 'fr.ts')} AS x
      FROM frame fr JOIN span USING (series) LEFT JOIN named_days d ON d.ds = fr.ts::DATE),
    train AS (SELECT series, list_append(x, value / peak) AS xy FROM designed WHERE value IS NOT NULL),
    {rs.gram_sql('gram', 'train', 'series', p)}, {rs.penalty_sql(model.penalty())},
    cells AS (
      SELECT g.series, g.i, g.j, g.v + CASE WHEN g.i = g.j THEN w ELSE 0 END AS v FROM gram g JOIN penalty USING (i)),
    {rs.solve_sql('fit', 'cells', 'series', p)},
    scored AS (SELECT *, {rs.dot_sql('x', 'coef', 1, p)} AS yhat FROM designed JOIN fit USING (series)),
    spread AS (SELECT series, sqrt(avg((value / peak - yhat) ** 2)) AS sigma FROM scored WHERE value IS NOT NULL GROUP BY 1),
    sizes AS (
      SELECT fit.series, list_sum(list_transform(coef[3:{2 + c}], lambda v: abs(v))) / {c} AS size, 86400.0::DOUBLE / (epoch(l) - epoch(f)) AS dt, sigma
      FROM fit JOIN span USING (series) JOIN spread USING (series)),
    drawn AS (
      SELECT series, ts, step, yhat, peak, size, dt, sigma, path, {draws}
      FROM scored JOIN sizes USING (series), (SELECT unnest(range(1, {paths + 1})) AS path) WHERE step > 0),
    moved AS (
      SELECT *, CASE WHEN u0 < {c} * dt THEN -size * sign(u1 - 0.5::DOUBLE) * ln(1 - 2 * abs(u1 - 0.5::DOUBLE)) ELSE 0 END AS change,
             sigma * sqrt(-2 * ln(u2)) * cos(2 * pi() * u3) AS noise FROM drawn),
    slopes AS (SELECT *, sum(change) OVER (PARTITION BY series, path ORDER BY step) AS slope FROM moved),
    paths AS (
      SELECT *, coalesce(sum(slope * dt) OVER (PARTITION BY series, path ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM slopes)
    SELECT series, ts, step::BIGINT AS step, round(any_value(yhat * peak), 2) AS yhat,
           round(quantile_cont(peak * (yhat + off + noise), 0.1), 2) AS yhat_lower, round(quantile_cont(peak * (yhat + off + noise), 0.9), 2) AS yhat_upper
    FROM paths GROUP BY 1, 2, 3"""


@query("trend_paths", _paths_sql(w.DAILY_LOAD_SQL, "daily_load", DAILY_MODEL, **PATHS))
def trend_paths(spark, folder):
    """A forecast whose bounds widen, as the trend may go on changing."""
    return tidy(decompose.trend_paths(w.daily_load(spark, folder), DAILY_MODEL, step_hours=24, **PATHS), 2)


@query(
    "future_frame",
    f"""WITH {w.HOURLY_LOAD_SQL}, l AS (SELECT series, max(ts) AS m FROM hourly_load GROUP BY 1)
    SELECT series, ts FROM hourly_load
    UNION ALL SELECT series, unnest(generate_series(m + INTERVAL 1 HOUR, m + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) FROM l""",
)
def future_frame(spark, folder):
    return decompose.future_frame(w.hourly_load(spark, folder), 24)


CUTOFFS_SQL = f"""{w.DAILY_LOAD_SQL}, span AS (SELECT series, min(ts) AS f, max(ts) AS l FROM daily_load GROUP BY 1),
cuts AS (
  SELECT series, k, l - INTERVAL 28 DAY - to_days((k * 100)::INT) AS cutoff
  FROM span, (SELECT unnest(range(0, 200)) AS k)
  WHERE l - INTERVAL 28 DAY - to_days((k * 100)::INT) >= f + INTERVAL 365 DAY)"""


@query("cv_cutoffs", f"WITH {CUTOFFS_SQL} SELECT series, k::BIGINT AS k, cutoff FROM cuts")
def cv_cutoffs(spark, folder):
    return tidy(cv.cutoffs(w.daily_load(spark, folder), **CV))


CV_SQL = f"""{CUTOFFS_SQL}, diffs AS (
  SELECT a.series, a.ts, (a.value - b.value) ** 2 AS sq
  FROM daily_load a JOIN daily_load b ON a.series = b.series AND b.ts = a.ts - INTERVAL 7 DAY),
spread AS (
  SELECT c.series, c.cutoff, sqrt(avg(d.sq)) AS s
  FROM cuts c JOIN diffs d ON d.series = c.series AND d.ts <= c.cutoff GROUP BY 1, 2),
cv AS (
  SELECT c.series, c.cutoff, a.ts, a.value AS actual, b.value AS pred,
         b.value - 1.2815515655446004::DOUBLE * s AS lower, b.value + 1.2815515655446004::DOUBLE * s AS upper
  FROM cuts c LEFT JOIN spread USING (series, cutoff)
  JOIN daily_load a ON a.series = c.series AND a.ts > c.cutoff AND a.ts <= c.cutoff + INTERVAL 28 DAY
  LEFT JOIN daily_load b ON b.series = c.series
    AND b.ts = a.ts - to_days((ceil(date_diff('day', c.cutoff, a.ts) / 7.0) * 7)::INT))"""


@query(
    "cv_seasonal_naive",
    f"WITH {CV_SQL} SELECT series, cutoff, ts, actual, pred, round(lower, 3) AS lower, round(upper, 3) AS upper FROM cv",
)
def cv_seasonal_naive(spark, folder):
    return tidy(cv.cv_seasonal_naive(w.daily_load(spark, folder), **CV), 3)


@query(
    "cv_metrics",
    f"""WITH {CV_SQL}
    SELECT date_diff('hour', cutoff, ts)::DOUBLE AS horizon_hours, count(pred)::BIGINT AS n, (count(*) - count(pred))::BIGINT AS n_missing,
           round(avg((actual - pred) ** 2) / 1e6, 4) AS mse, round(sqrt(avg((actual - pred) ** 2)), 4) AS rmse,
           round(avg(abs(actual - pred)), 4) AS mae,
           round(avg(CASE WHEN actual <> 0 THEN abs((actual - pred) / actual) END), 4) AS mape,
           round(avg((actual BETWEEN lower AND upper)::INT), 4) AS coverage
    FROM cv GROUP BY 1""",
)
def cv_metrics(spark, folder):
    scores = cv.cv_metrics(cv.cv_seasonal_naive(w.daily_load(spark, folder), **CV))
    return tidy(scores.withColumn("mse", F.col("mse") / 1e6), 4)


def _cv_additive_sql(model):
    p = len(model.penalty())
    return f"""WITH RECURSIVE {CUTOFFS_SQL}, {w.HOLIDAYS_SQL}, {rs.NAMED_DAYS_SQL},
    peaks AS (
      SELECT series, f, l, max(abs(value)) AS peak FROM daily_load JOIN span USING (series)
      WHERE ts <= f + INTERVAL 365 DAY GROUP BY ALL),
    designed AS (
      SELECT a.series, a.ts, a.value, peak, {rs.design_sql(model, 'a.ts')} AS x
      FROM daily_load a JOIN peaks USING (series) LEFT JOIN named_days d ON d.ds = a.ts::DATE),
    stretch AS (
      SELECT d.series, max(c.k) AS k, any_value(list_append(x, value / peak)) AS xy
      FROM designed d JOIN cuts c ON c.series = d.series AND d.ts <= c.cutoff GROUP BY d.series, d.ts),
    {rs.gram_sql('part', 'stretch', 'series, k', p)},
    gram AS (
      SELECT series, k, i, j, sum(v) OVER (PARTITION BY series, i, j ORDER BY k DESC) AS v FROM part),
    {rs.penalty_sql(model.penalty())},
    cells AS (
      SELECT g.series, g.k, g.i, g.j, g.v + CASE WHEN g.i = g.j THEN w ELSE 0 END AS v FROM gram g JOIN penalty USING (i)),
    {rs.solve_sql('fit', 'cells', 'series, k', p)},
    spread AS (
      SELECT c.series, c.k, sqrt(avg((value - peak * {rs.dot_sql('x', 'coef', 1, p)}) ** 2)) AS s
      FROM cuts c JOIN fit USING (series, k) JOIN designed d ON d.series = c.series AND d.ts <= c.cutoff GROUP BY 1, 2),
    cv AS (
      SELECT c.series, c.cutoff, d.ts, d.value AS actual, peak * {rs.dot_sql('x', 'coef', 1, p)} AS pred, s
      FROM cuts c JOIN fit USING (series, k) JOIN spread USING (series, k)
      JOIN designed d ON d.series = c.series AND d.ts > c.cutoff AND d.ts <= c.cutoff + INTERVAL 28 DAY)
    SELECT series, cutoff, ts, actual, round(pred, 2) AS pred,
           round(pred - 1.2815515655446004::DOUBLE * s, 2) AS lower,
           round(pred + 1.2815515655446004::DOUBLE * s, 2) AS upper FROM cv"""


@query("cv_additive", _cv_additive_sql(DAILY_MODEL))
def cv_additive(spark, folder):
    return tidy(decompose.cross_validate(w.daily_load(spark, folder), **CV), 2)


# --- recursive forecasts ---------------------------------------------------------------------


@query(
    "recursive_ar1",
    f"""WITH RECURSIVE {INDEXED_SQL}, pairs AS (
      SELECT a.series, a.value AS y, b.value AS z FROM x a JOIN x b ON a.series = b.series AND b.t = a.t - 1),
    m AS (SELECT series, regr_slope(y, z) AS b, regr_intercept(y, z) AS a FROM pairs GROUP BY 1),
    f AS (
      SELECT series, 0 AS step, value AS pred, a, b FROM x JOIN m USING (series) WHERE t = n - 1
      UNION ALL SELECT series, step + 1, a + b * pred, a, b FROM f WHERE step < 48)
    SELECT series, step::BIGINT AS step, round(pred, 5) AS pred FROM f WHERE step > 0""",
)
def recursive_ar1(spark, folder):
    return tidy(recursive.recursive_forecast(w.hourly_load(spark, folder), 1, 48), 5)


def _ar_sql(rows, p, horizon):
    """CTEs for an AR(p) model of ``rows`` (series, t, value, n): ``f`` holds the growing histories."""
    lagged = "list_prepend(1.0::DOUBLE, list_reverse(list(b.value ORDER BY b.t)))"
    weights = " + ".join(f"coef[{j + 1}] * h[len(h) - {j - 1}]" for j in range(1, p + 1))
    return f"""lagged AS (
      SELECT a.series, a.t, list_append({lagged}, any_value(a.value)) AS xy
      FROM {rows} a JOIN {rows} b ON a.series = b.series AND b.t BETWEEN a.t - {p} AND a.t - 1
      WHERE a.t >= {p} GROUP BY a.series, a.t),
    {rs.gram_sql('gram', 'lagged', 'series', p + 1)}, {rs.solve_sql('fit', 'gram', 'series', p + 1)},
    f AS (
      SELECT series, 0 AS step, coef, h FROM fit JOIN (
        SELECT series, list(value ORDER BY t) AS h FROM {rows} WHERE t >= n - {p} GROUP BY 1) USING (series)
      UNION ALL SELECT series, step + 1, coef, list_append(h, coef[1] + {weights}) FROM f WHERE step < {horizon})"""


@query(
    "recursive_forecast",
    f"""WITH RECURSIVE {INDEXED_SQL}, {_ar_sql('x', 24, 168)}
    SELECT series, step::BIGINT AS step, round(h[len(h)], 3) AS pred FROM f WHERE step > 0""",
)
def recursive_forecast(spark, folder):
    return tidy(recursive.recursive_forecast(w.hourly_load(spark, folder), 24, 168), 3)


@query(
    "forecast_tail",
    f"""WITH RECURSIVE {INDEXED_SQL}, hist AS (SELECT series, t, value, n - 48 AS n FROM x WHERE t < n - 48),
    {_ar_sql('hist', 24, 48)}
    SELECT series, 'history' AS role, (t - n + 48)::BIGINT AS pos, value FROM x WHERE t BETWEEN n - 98 AND n - 48
    UNION ALL SELECT series, 'actual', (t - n + 48)::BIGINT, value FROM x WHERE t >= n - 48
    UNION ALL SELECT series, 'forecast', (step - 1)::BIGINT, round(h[len(h)], 3) FROM f WHERE step > 0""",
)
def forecast_tail(spark, folder):
    return tidy(recursive.forecast_tail(w.hourly_load(spark, folder), 48, 24), 3)


NETWORK = sequence.Network(layers=5, filters=8, hidden=16, epochs=12, batches=2, rate=0.01)


@query("sequence_forecast")
def sequence_forecast(spark, folder):
    """The last 48 hours, held out, beside the forecasts of the trained sequence model and of the linear one."""
    indexed = segments.index_rows(w.hourly_load(spark, folder), ["series"], "ts")
    ahead = F.col(segments.RN) - F.col(segments.SIZE) + 48
    history = indexed.filter(ahead < 0).select("series", "ts", "value")
    actual = indexed.filter(ahead >= 0).select("series", (ahead + 1).cast("int").alias("step"), F.col("value").alias("actual"))
    net = sequence.sequence_forecast(history, 96, 24, 48, 12, NETWORK).withColumnRenamed("pred", "network")
    linear = recursive.recursive_forecast(history, 24, 48).withColumnRenamed("pred", "linear")
    return tidy(actual.join(net, ["series", "step"], "left").join(linear, ["series", "step"], "left"), 4)


# --- weekly shapes ---------------------------------------------------------------------------


def _shapes_sql(source, name, length, off):
    return f"""{source}, {w.HOLIDAYS_SQL}, flagged AS (
      SELECT l.series, l.ts, l.value, year(l.ts) AS year, weekofyear(l.ts) AS week,
             greatest((isodow(l.ts) > 5)::INT, (o.ds IS NOT NULL)::INT) AS off_flag
      FROM {name} l LEFT JOIN off_days o ON o.ds = l.ts::DATE),
    shapes AS (
      SELECT series, year::BIGINT AS year, week::BIGINT AS week, list(value ORDER BY ts) AS shape
      FROM flagged GROUP BY 1, 2, 3 HAVING sum(off_flag) = {off} AND count(*) = {length})"""


SHIP_SHAPES_SQL = _shapes_sql(w.SHIP_DAILY_SQL, "ship_daily", 7, 2)
WEEK_SHAPES_SQL = _shapes_sql(w.HOURLY_TOTAL_SQL, "hourly_total", 168, 48)
DAY_SHAPES_SQL = f"""{w.HOURLY_LOAD_SQL}, shapes AS (
  SELECT series, year(ts)::BIGINT AS year, dayofyear(ts)::BIGINT AS week, list(value ORDER BY ts) AS shape
  FROM hourly_load GROUP BY 1, 2, 3 HAVING count(*) = 24)"""


def day_shapes(spark, folder):
    """The days with all 24 hours; the day of the year stands where a weekly shape has its week."""
    return shapes.daily_shapes(w.hourly_load(spark, folder)).withColumnRenamed("day", "week")


def ship_shapes(spark, folder):
    return shapes.weekly_shapes(w.ship_daily(spark, folder), length=7, off_units=2)


def _positions(df):
    return tidy(df.select("series", "year", "week", F.posexplode("shape").alias("pos", "value")))


@query(
    "weekly_shapes",
    f"""WITH {_shapes_sql(w.HOURLY_TOTAL_SQL, "hourly_total", 168, 48)}
    SELECT series, year, week, unnest(range(0, 168))::BIGINT AS pos, unnest(shape) AS value FROM shapes""",
)
def weekly_shapes(spark, folder):
    return _positions(shapes.weekly_shapes(w.hourly_total(spark, folder)))


@query(
    "weekly_shapes_daily",
    f"""WITH {SHIP_SHAPES_SQL}
    SELECT series, year, week, unnest(range(0, 7))::BIGINT AS pos, unnest(shape) AS value FROM shapes""",
)
def weekly_shapes_daily(spark, folder):
    return _positions(ship_shapes(spark, folder))


@query(
    "complete_weeks",
    f"""WITH {w.SHIP_DAILY_SQL}
    SELECT series, year(ts)::BIGINT AS year, weekofyear(ts)::BIGINT AS week, round(sum(value), 2) AS total
    FROM ship_daily GROUP BY 1, 2, 3 HAVING count(*) = 7""",
)
def complete_weeks(spark, folder):
    load = w.ship_daily(spark, folder)
    cells = F.array_sort(F.collect_list(F.struct("ts", "value")))
    weeks = load.groupBy("series", F.year("ts").alias("year"), F.weekofyear("ts").alias("week")).agg(
        F.transform(cells, lambda c: c["value"]).alias("shape")
    )
    total = F.aggregate("shape", F.lit(0.0), lambda t, v: t + v)
    return tidy(shapes.complete_weeks(weeks, 7).select("series", "year", "week", total.alias("total")), 2)


def _pairs_sql(source):
    return f"""{source}, pairs AS (
  SELECT * FROM (
    SELECT series, year, week, shape AS a, lead(shape) OVER (PARTITION BY series ORDER BY year, week) AS b FROM shapes)
  WHERE b IS NOT NULL)"""


PAIRS_SQL = _pairs_sql(SHIP_SHAPES_SQL)


def _dtw_sql(name, source, keys, band=4):
    """DTW of list columns a and b of ``source``: one recursion step per row of the cost matrix."""
    inside = f"j >= greatest(0, i - {band}) AND j < least(len(b), i + {band})"
    cell = "(a[i + 1] - b[j + 1]) ** 2 + least(prev[j + 2], acc[j + 1], prev[j + 1])"
    step = f"""list_reduce(list_transform(range(0, len(b)), lambda z: [z::DOUBLE]),
               lambda acc, z: list_append(acc, CASE WHEN {inside.replace('j', 'z[1]')}
                 THEN {cell.replace('[j + 2]', '[z[1]::BIGINT + 2]').replace('[j + 1]', '[z[1]::BIGINT + 1]')}
                 ELSE 'inf'::DOUBLE END), ['inf'::DOUBLE])"""
    return f"""{name}_dp AS (
      SELECT {keys}, a, b, 0 AS i, list_prepend(0::DOUBLE, list_transform(b, lambda v: 'inf'::DOUBLE)) AS prev FROM {source}
      UNION ALL SELECT {keys}, a, b, i + 1, {step} FROM {name}_dp WHERE i < len(a)),
    {name} AS (SELECT {keys}, sqrt(prev[len(prev)]) AS dtw FROM {name}_dp WHERE i = len(a))"""


@query(
    "dtw_pairs",
    f"WITH RECURSIVE {PAIRS_SQL}, {_dtw_sql('d', 'pairs', 'series, year, week')} SELECT series, year, week, round(dtw, 6) AS dtw FROM d",
)
def dtw_pairs(spark, folder):
    """Distance of each weekly shape to the next one of its series."""
    pairs = shapes.week_pairs(ship_shapes(spark, folder))
    return tidy(shapes.dtw_pairs(pairs).select("series", "year", "week", "dtw"))


def _keogh_sql(pairs, n):
    return f"""WITH {pairs}, cells AS (
      SELECT series, year, week, unnest(range(1, {n + 1})) AS i, unnest(a) AS x, b FROM pairs),
    env AS (
      SELECT *, list_min(b[greatest(i - 5, 1):least(i + 4, {n})]) AS lo, list_max(b[greatest(i - 5, 1):least(i + 4, {n})]) AS hi
      FROM cells)
    SELECT series, year, week, round(sqrt(sum(greatest(x - hi, lo - x, 0) ** 2)), 6) AS lb
    FROM env GROUP BY 1, 2, 3"""


@query("lb_keogh", _keogh_sql(PAIRS_SQL, 7))
def lb_keogh(spark, folder):
    pairs = shapes.week_pairs(ship_shapes(spark, folder))
    return tidy(shapes.lb_pairs(pairs).select("series", "year", "week", "lb"))


@query(
    "dtw_pairs_days",
    f"WITH RECURSIVE {_pairs_sql(DAY_SHAPES_SQL)}, {_dtw_sql('d', 'pairs', 'series, year, week')} SELECT series, year, week, round(dtw, 6) AS dtw FROM d",
)
def dtw_pairs_days(spark, folder):
    """Distance of each full day of 24 hours to the next one of its series."""
    pairs = shapes.week_pairs(day_shapes(spark, folder))
    return tidy(shapes.dtw_pairs(pairs).select("series", "year", "week", "dtw"))


@query(
    "dtw_pairs_weeks",
    f"WITH RECURSIVE {_pairs_sql(WEEK_SHAPES_SQL)}, {_dtw_sql('d', 'pairs', 'series, year, week')} SELECT series, year, week, round(dtw, 6) AS dtw FROM d",
)
def dtw_pairs_weeks(spark, folder):
    """Distance of each week of 168 hours to the next one."""
    pairs = shapes.week_pairs(shapes.weekly_shapes(w.hourly_total(spark, folder)))
    return tidy(shapes.dtw_pairs(pairs).select("series", "year", "week", "dtw"))


@query("lb_keogh_days", _keogh_sql(_pairs_sql(DAY_SHAPES_SQL), 24))
def lb_keogh_days(spark, folder):
    pairs = shapes.week_pairs(day_shapes(spark, folder))
    return tidy(shapes.lb_pairs(pairs).select("series", "year", "week", "lb"))


@query("lb_keogh_weeks", _keogh_sql(_pairs_sql(WEEK_SHAPES_SQL), 168))
def lb_keogh_weeks(spark, folder):
    pairs = shapes.week_pairs(shapes.weekly_shapes(w.hourly_total(spark, folder)))
    return tidy(shapes.lb_pairs(pairs).select("series", "year", "week", "lb"))


@query(
    "nearest_weeks",
    f"""WITH RECURSIVE {SHIP_SHAPES_SQL}, met AS (
      SELECT q.series, q.year, q.week, s.series AS near_series, s.year AS near_year, s.week AS near_week, q.shape AS a, s.shape AS b
      FROM shapes q JOIN shapes s ON q.week = 20 AND (q.series, q.year, q.week) <> (s.series, s.year, s.week)),
    {_dtw_sql('d', 'met', 'series, year, week, near_series, near_year, near_week')},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY series, year, week ORDER BY dtw, near_series, near_year, near_week) AS rank FROM d)
    SELECT series, year, week, rank::BIGINT AS rank, near_series, near_year, near_week, round(dtw, 6) AS dist FROM ranked WHERE rank <= 3""",
)
def nearest_weeks(spark, folder):
    """The three weeks nearest to each week 20, of any series and year."""
    return tidy(nearest.nearest_shapes(ship_shapes(spark, folder), F.col("week") == 20, 3))


def _kmeans_sql(k, rounds):
    """k-means unrolled: each round is a cross product of shapes with the k centroids."""
    parts = [
        DAY_SHAPES_SQL,
        f"""c0 AS (
          SELECT (row_number() OVER (ORDER BY h, series, year, week) - 1)::BIGINT AS cluster, shape AS centroid
          FROM (SELECT *, md5(series || '|' || year || '|' || week) AS h FROM shapes ORDER BY h, series, year, week LIMIT {k}))""",
    ]
    for n in range(rounds):
        parts.append(
            f"x{n} AS (SELECT series, year, week, cluster, shape AS a, centroid AS b FROM shapes CROSS JOIN c{n})"
        )
        parts.append(_dtw_sql(f"d{n}", f"x{n}", "series, year, week, cluster"))
        parts.append(
            f"""a{n} AS MATERIALIZED (
              SELECT series, year, week, cluster, dtw FROM (
                SELECT *, row_number() OVER (PARTITION BY series, year, week ORDER BY dtw, cluster) AS k FROM d{n})
              WHERE k = 1)"""
        )
        parts.append(
            f"""c{n + 1} AS MATERIALIZED (
              SELECT c.cluster, coalesce(m.centroid, c.centroid) AS centroid
              FROM c{n} c LEFT JOIN (
                SELECT cluster, list(v ORDER BY pos) AS centroid FROM (
                  SELECT cluster, pos, avg(v) AS v FROM (
                    SELECT cluster, unnest(range(0, 24)) AS pos, unnest(shape) AS v
                    FROM a{n} JOIN shapes USING (series, year, week)) GROUP BY 1, 2) GROUP BY 1) m USING (cluster))"""
        )
    return ",\n".join(parts)


# the same rounds on both sides, at any scale
ROUNDS = 8
KMEANS_SQL = _kmeans_sql(4, ROUNDS)


def clusters(spark, folder):
    return shapes.dtw_kmeans(day_shapes(spark, folder), k=4, iters=ROUNDS)


@query("dtw_kmeans", f"WITH RECURSIVE {KMEANS_SQL} SELECT series, year, week, cluster, round(dtw, 6) AS dist FROM a{ROUNDS - 1}")
def dtw_kmeans(spark, folder):
    assigned, _ = clusters(spark, folder)
    return tidy(assigned.select("series", "year", "week", "cluster", "dist"))


@query(
    "dtw_centroids",
    f"""WITH RECURSIVE {KMEANS_SQL}
    SELECT cluster, unnest(range(0, 24))::BIGINT AS pos, round(unnest(centroid), 6) AS value FROM c{ROUNDS}""",
)
def dtw_centroids(spark, folder):
    _, centroids = clusters(spark, folder)
    return tidy(centroids.select("cluster", F.posexplode("centroid").alias("pos", "value")))


@query("barycentres", f"WITH {DAY_SHAPES_SQL} SELECT least(4, count(*))::BIGINT AS clusters, count(*)::BIGINT AS days, true AS settled FROM shapes")
def barycentres(spark, folder):
    """Clusters around barycentres: a further round assigns no day anew."""
    days = day_shapes(spark, folder)
    assigned, centroids = shapes.dtw_kmeans(days, k=4, iters=100, barycentres=True)
    centres = [row["centroid"] for row in centroids.orderBy("cluster").collect()]
    again = shapes.assign_clusters(days, centres).select("series", "year", "week", F.col("cluster").alias("again"))
    both = assigned.select("series", "year", "week", "cluster").join(again, ["series", "year", "week"])
    return both.agg(F.lit(len(centres)).cast("bigint").alias("clusters"), F.count(F.lit(1)).alias("days"), (F.count_if(F.col("cluster") != F.col("again")) == 0).alias("settled"))


@query(
    "cluster_weeks",
    f"""WITH RECURSIVE {KMEANS_SQL}, totals AS (
      SELECT series, year, week, round(list_sum(shape), 2) AS total FROM shapes)
    SELECT series, year, week, cluster, total FROM a{ROUNDS - 1} JOIN totals USING (series, year, week)""",
)
def cluster_weeks(spark, folder):
    assigned, _ = clusters(spark, folder)
    total = F.aggregate("shape", F.lit(0.0), lambda t, v: t + v)
    weeks = day_shapes(spark, folder).select("series", "year", "week", F.round(total, 2).alias("total"))
    return tidy(shapes.cluster_weeks(assigned, weeks)).orderBy("cluster", "year", "week", "series")


@query(
    "cluster_calendar",
    f"WITH RECURSIVE {KMEANS_SQL} SELECT week, cluster, count(*)::BIGINT AS weeks FROM a{ROUNDS - 1} GROUP BY 1, 2",
)
def cluster_calendar(spark, folder):
    assigned, _ = clusters(spark, folder)
    return tidy(shapes.cluster_calendar(assigned))


@query(
    "unassigned_weeks",
    f"""WITH RECURSIVE {KMEANS_SQL}, every_week AS (
      SELECT DISTINCT series, year(ts)::BIGINT AS year, dayofyear(ts)::BIGINT AS week FROM hourly_load)
    SELECT e.series, e.year, e.week FROM every_week e ANTI JOIN a{ROUNDS - 1} USING (series, year, week)""",
)
def unassigned_weeks(spark, folder):
    """Days of the table that are in no cluster: the incomplete ones."""
    assigned, _ = clusters(spark, folder)
    weeks = w.hourly_load(spark, folder).select(
        "series", F.year("ts").alias("year"), F.dayofyear("ts").alias("week")
    ).distinct()
    return tidy(shapes.unassigned(weeks, assigned))

"""Tree forecasts on a feature table with a ``split`` column.

Rows with split 'train' fit the model; every row is scored, so train and test share one frame. One
model serves the frame it is given: several series need their own frames, or the series as a feature.
"""

from __future__ import annotations

import warnings
from math import ceil

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.sources.files import ensure_checkpoint_dir

TRAIN = "split = 'train'"
#: The deepest tree that Spark's learner can grow.
DEEPEST = 30


def _pipeline(features, estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), estimator])


def fit_tree(df, features, label="value", min_leaf=20, max_depth=DEEPEST, max_bins=256, seed=0) -> PipelineModel:
    """Regression tree grown until no leaf can be split into two of ``min_leaf`` rows.

    The learner's own limit is ``DEEPEST`` levels; a warning tells if a tree reaches it.
    """
    tree = DecisionTreeRegressor(
        featuresCol="_features", labelCol=label, predictionCol="pred", seed=seed,
        minInstancesPerNode=min_leaf, maxDepth=max_depth, maxBins=max_bins,
    )
    model = _pipeline(features, tree).fit(df.filter(TRAIN))
    if max_depth == DEEPEST == model.stages[-1].depth:
        warnings.warn(f"the tree has {DEEPEST} levels, the learner's limit; some leaves may be coarser than asked", stacklevel=2)
    return model


def fit_gbt(
    df, features, label="value", rounds=100, min_leaf=10, max_depth=3, rate=0.1, max_bins=64, seed=0
) -> PipelineModel:
    """Boosted trees with squared loss. The learner checkpoints its row state every ten rounds."""
    ensure_checkpoint_dir(df.sparkSession)
    gbt = GBTRegressor(
        featuresCol="_features", labelCol=label, predictionCol="pred", seed=seed, lossType="squared",
        maxIter=rounds, stepSize=rate, maxDepth=max_depth, minInstancesPerNode=min_leaf, maxBins=max_bins,
    )
    return _pipeline(features, gbt).fit(df.filter(TRAIN))


def score(model: PipelineModel, df) -> DataFrame:
    return model.transform(df).drop("_features")


def tree_forecast(df, features, label="value", **params) -> DataFrame:
    return score(fit_tree(df, features, label, **params), df)


def gbt_forecast(df, features, label="value", **params) -> DataFrame:
    return score(fit_gbt(df, features, label, **params), df)


def _ranked(rows, places: dict, buckets: int = 1024) -> dict:
    """{group: the place-th smallest ``r``} of rows (g, r), exactly.

    Counts in equal-width buckets combine on the map side; the bucket that holds the place is cut again
    until it holds one value. At most ``buckets`` rows a group come to the driver in a pass.
    """
    spans = {x["g"]: (x["lo"], x["hi"], places[x["g"]]) for x in rows.groupBy("g").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).collect()}
    found = {g: lo for g, (lo, hi, _) in spans.items() if lo == hi}
    while len(found) < len(spans):
        todo = {g: s for g, s in spans.items() if g not in found}
        span = F.create_map(*[F.lit(v) for g, (lo, hi, _) in todo.items() for v in (g, F.array(F.lit(lo), F.lit(hi)))])
        cut = rows.withColumn("_s", F.element_at(span, F.col("g")))
        lo, hi = F.get("_s", F.lit(0)), F.get("_s", F.lit(1))
        inside = cut.filter(F.col("_s").isNotNull() & (F.col("r") >= lo) & (F.col("r") <= hi))
        bucket = F.floor((F.col("r") - lo) / (hi - lo) * buckets).alias("b")
        counts = inside.groupBy("g", bucket).agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()
        for g, (_, _, place) in todo.items():
            for x in sorted((x for x in counts if x["g"] == g), key=lambda x: x["b"]):
                if place <= x["n"]:
                    spans[g] = (x["lo"], x["hi"], place)
                    if x["lo"] == x["hi"] or place in (1, x["n"]):
                        found[g] = x["lo"] if place == 1 else x["hi"]
                    break
                place -= x["n"]
    return found


def quantile_forecasts(
    df, features, alphas: dict[str, float], label="value", rounds=100, rate=0.1, max_depth=3, min_leaf=10,
    max_bins=64, checkpoint_every=10, seed=0,
) -> DataFrame:
    """Boosted trees for several quantiles at once; adds a forecast column for each name of ``alphas``.

    Each round fits a tree to the pinball gradient of the current fit, then gives each leaf the quantile
    of its residuals, exactly and for all trees of the round together. Only the at most 2^max_depth leaf
    values of each tree come to the driver, and they return as a literal map. The row state is
    checkpointed every few rounds and at the end, so that what is returned is not computed again.
    """
    ensure_checkpoint_dir(df.sparkSession)
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    rows = assembler.transform(df).checkpoint()
    usable = F.expr(TRAIN) & F.col(label).isNotNull()
    n = rows.filter(usable).count()
    if not n:
        raise ValueError("no training rows")
    each = F.explode(F.array(*[F.lit(name) for name in alphas])).alias("g")
    start = _ranked(rows.filter(usable).select(each, F.col(label).alias("r")), {name: max(1, ceil(a * n)) for name, a in alphas.items()})
    state = rows.withColumns({name: F.lit(float(start[name])) for name in alphas}).persist()
    for done in range(1, rounds + 1):
        before, train = state, state.filter(usable)
        for name, alpha in alphas.items():
            gradient = F.when(F.col(label) > F.col(name), F.lit(alpha)).otherwise(F.lit(alpha - 1.0))
            tree = DecisionTreeRegressor(
                featuresCol="_features", labelCol="_gradient", predictionCol="_tree", leafCol=f"_leaf_{name}",
                maxDepth=max_depth, minInstancesPerNode=min_leaf, maxBins=max_bins, seed=seed,
            ).fit(train.withColumn("_gradient", gradient))
            state = tree.transform(state).drop("_tree")
        placed = state.persist()
        pairs = [F.struct(F.concat(F.lit(name + " "), F.col(f"_leaf_{name}").cast("int").cast("string")).alias("g"), (F.col(label) - F.col(name)).alias("r")) for name in alphas]
        residuals = placed.filter(usable).select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
        sizes = {x["g"]: x["count"] for x in residuals.groupBy("g").count().collect()}
        leaves = _ranked(residuals, {g: max(1, ceil(alphas[g.rpartition(" ")[0]] * k)) for g, k in sizes.items()})
        step = F.create_map(*[F.lit(v) for g, value in leaves.items() for v in (g, float(value))])
        moved = {}
        for name in alphas:
            leaf = F.concat(F.lit(name + " "), F.col(f"_leaf_{name}").cast("int").cast("string"))
            moved[name] = F.col(name) + F.lit(rate) * F.coalesce(F.element_at(step, leaf), F.lit(0.0))
        state = placed.withColumns(moved).drop(*[f"_leaf_{name}" for name in alphas])
        if done % checkpoint_every == 0 or done == rounds:
            state = state.checkpoint()
        else:
            state = state.persist()
            state.count()  # before what it is made from goes
        placed.unpersist()
        before.unpersist()
    return state.drop("_features")


def quantile_gbt(df, features, alpha: float, label="value", **params) -> DataFrame:
    """Boosted trees for the ``alpha`` quantile; adds ``pred`` to every row."""
    return quantile_forecasts(df, features, {"pred": alpha}, label, **params)


def quantile_band(df, features, alpha=0.99, label="value", **params) -> DataFrame:
    """Lower, middle and upper quantile forecasts (1 - alpha, 0.5, alpha) next to the actual."""
    return quantile_forecasts(df, features, {"lower": 1.0 - alpha, "mid": 0.5, "upper": alpha}, label, **params)

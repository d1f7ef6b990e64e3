"""Recursive multi-step forecasts: predict one step, append it, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.operators.linear import cross_products, solve
from hourline.operators.segments import RN, SIZE, index_rows
from hourline.operators.windows import row_lags

KEYS = ("series",)


def fit_ar(df, p: int, ridge=0.0, keys=KEYS, ts="ts", value="value") -> DataFrame:
    """(keys, coef): constant and weights of the last p rows, newest first.

    A row that lacks its value or one of its lags doesn't take part in the fit."""
    rows = row_lags(df, p, keys, ts, value).select(
        *keys, F.array(F.lit(1.0), *[f"lag_{k}" for k in range(1, p + 1)]).alias("x"), F.col(value).alias("y")
    )
    return solve(cross_products(rows, keys), keys, [0.0] + [ridge] * p).select(*keys, "coef")


def last_values(df, n: int, keys=KEYS, ts="ts", value="value") -> DataFrame:
    """(keys, tail): the last n values of each series, oldest first."""
    tail = index_rows(df, keys, ts).filter(F.col(RN) >= F.col(SIZE) - n)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(RN).alias("pos"), F.col(value).alias("v"))))
    return tail.groupBy(*keys).agg(F.transform(ordered, lambda c: c["v"]).alias("tail"))


def recursive_forecast(df, p: int, horizon: int, ridge=0.0, keys=KEYS, ts="ts", value="value") -> DataFrame:
    """(keys, step, pred) for steps 1..horizon of a per-series AR(p) model.

    A NULL among the last p values makes the forecast NULL. The loop over the horizon runs inside Spark's ``aggregate`` on an array of p + horizon values.
    """
    model = fit_ar(df, p, ridge, keys, ts, value)
    state = last_values(df, p, keys, ts, value).join(model, list(keys))

    def step(history, _):
        terms = F.transform(
            F.sequence(F.lit(1), F.lit(p)),
            lambda j: F.element_at("coef", j + 1) * F.element_at(history, -j),
        )
        return F.array_append(history, F.aggregate(terms, F.element_at("coef", 1), lambda t, v: t + v))

    full = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("tail"), step)
    ahead = F.slice(full, p + 1, horizon)
    return state.filter(F.size("tail") == p).select(*keys, F.posexplode(ahead).alias("_i", "pred")).select(
        *keys, (F.col("_i") + 1).alias("step"), "pred"
    )


def forecast_tail(df, horizon: int, p: int, tail=50, keys=KEYS, ts="ts", value="value") -> DataFrame:
    """(keys, role, pos, value): the end of the history, the actuals held out, and the forecast.

    The last ``horizon`` rows are held out; the history tail is followed by the first held-out row.
    """
    indexed = index_rows(df, keys, ts)
    cut = F.col(SIZE) - horizon
    history = indexed.filter(F.col(RN) < cut)
    rows = indexed.filter(F.col(RN) >= cut - tail).withColumn("pos", F.col(RN) - cut)
    shown = rows.filter(F.col("pos") <= 0).select(*keys, F.lit("history").alias("role"), "pos", value)
    actual = rows.filter(F.col("pos") >= 0).select(*keys, F.lit("actual").alias("role"), "pos", value)
    pred = recursive_forecast(history.drop(RN, SIZE), p, horizon, keys=keys, ts=ts, value=value).select(
        *keys, F.lit("forecast").alias("role"), (F.col("step") - 1).cast("bigint").alias("pos"),
        F.col("pred").alias(value),
    )
    return shown.unionByName(actual).unionByName(pred)

"""Forecast scores over a frame of (keys, ts, actual, pred).

Actual and forecast share a row because they were joined on their key, never by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourline.operators.segments import RN, SIZE, index_rows

KEYS = ("series",)
#: Share of a series that its quantile summary may be off by, twice over.
SHARE = 2e-4


def abs_error(actual="actual", pred="pred") -> Column:
    return F.abs(F.col(actual) - F.col(pred))


def abs_pct_error(actual="actual", pred="pred") -> Column:
    """NULL where the actual is 0, so such rows leave the average; count them with ``n_zero``."""
    return F.abs(F.try_divide(F.col(actual) - F.col(pred), F.col(actual)))


def pinball_loss(q: float, actual="actual", pred="pred") -> Column:
    e = F.col(actual) - F.col(pred)
    return F.greatest(F.lit(q) * e, F.lit(q - 1) * e)


def align(actuals, preds, on) -> DataFrame:
    """Join actuals and forecasts on their key; a key on one side only is an error, not a lost row."""
    a = actuals.withColumn("_a", F.lit(True))
    p = preds.withColumn("_p", F.lit(True))
    both = F.col("_a").isNotNull() & F.col("_p").isNotNull()
    checked = a.join(p, list(on), "full_outer").withColumn(
        "_ok", F.when(both, True).otherwise(F.raise_error(F.lit("actual and forecast keys differ")))
    )
    # the filter keeps the check in the plan
    return checked.filter("_ok").drop("_a", "_p", "_ok")


def mae(df, keys=KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(abs_error()).alias("mae"))


def mape(df, keys=KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(abs_pct_error()).alias("mape"),
        F.count_if(F.col("actual") == 0).alias("n_zero"),
    )


def _scored() -> Column:
    return F.col("actual").isNotNull() & F.col("pred").isNotNull()


def accuracy(df, keys=KEYS) -> DataFrame:
    """1 - MAE / mean(actual) over the rows that have both; ``n_missing`` counts the others."""
    actual = F.when(_scored(), F.col("actual"))
    return df.groupBy(*keys).agg(
        (F.lit(1) - F.try_divide(F.avg(abs_error()), F.avg(actual))).alias("accuracy"),
        F.count_if(~_scored()).alias("n_missing"),
    )


def r2(df, keys=KEYS) -> DataFrame:
    """1 - residual / total sum of squares over the rows that have both; ``n_missing`` counts the others."""
    e = F.col("actual") - F.col("pred")
    actual = F.when(_scored(), F.col("actual"))
    return df.groupBy(*keys).agg(
        (F.lit(1) - F.try_divide(F.sum(e * e), F.var_pop(actual) * F.count(actual))).alias("r2"),
        F.count_if(~_scored()).alias("n_missing"),
    )


def pinball(df, q: float, keys=KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(pinball_loss(q)).alias("pinball"))


def quantile_score(df, q: float, keys=KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.try_divide(F.lit(1.0), F.sum(pinball_loss(q))).alias("quantile_score")
    )


def interval_breaches(df, keys=KEYS) -> DataFrame:
    """Counts and shares of actuals above ``upper`` and below ``lower``."""
    above, below = F.col("actual") > F.col("upper"), F.col("actual") < F.col("lower")
    return df.groupBy(*keys).agg(
        F.count_if(above).alias("upper_breaches"),
        F.avg(above.cast("int")).alias("upper_rate"),
        F.count_if(below).alias("lower_breaches"),
        F.avg(below.cast("int")).alias("lower_rate"),
    )


def _error(metric: str) -> Column:
    return {"mae": abs_error, "mape": abs_pct_error}[metric]()


def per_block(df, metric: str, block: int, keys=KEYS, ts="ts") -> DataFrame:
    """Error of each run of ``block`` consecutive rows; a short last run is dropped."""
    indexed = index_rows(df, keys, ts)
    step = F.floor(F.col(RN) / block)
    full = step < F.floor(F.col(SIZE) / block)
    return indexed.filter(full).groupBy(*keys, step.alias("step")).agg(F.avg(_error(metric)).alias(metric))


def mean_of_blocks(blocks, metric: str, keys=KEYS) -> DataFrame:
    return blocks.groupBy(*keys).agg(F.count(metric).alias("steps"), F.avg(metric).alias(metric))


def cumulative(df, metric: str, steps, block: int, keys=KEYS, ts="ts") -> DataFrame:
    """Error of the first ``s * block`` rows for each s, as one conditional aggregation."""
    indexed = index_rows(df, keys, ts)
    wide = indexed.groupBy(*keys).agg(
        *[F.avg(F.when(F.col(RN) < s * block, _error(metric))).alias(str(s)) for s in steps]
    )
    cells = F.array(*[F.struct(F.lit(s).alias("steps"), F.col(str(s)).alias(metric)) for s in steps])
    return wide.select(*keys, F.inline(cells))


def trimmed_mean(df, value: str, drop: int, keys=KEYS) -> DataFrame:
    """Mean without the ``drop`` largest values. A series with at most ``drop`` values has no result.

    One pass counts a series and summarises its quantiles, which combine on the map side; from them follows a bound that the smallest
    dropped value reaches. The different values from the bound on, with their counts, are some ``drop`` and a share of ``SHARE`` of the series; a running count over them
    gives the cut, exactly. Sums below and at the cut give the mean; no series is sorted.
    """
    usable = df.filter(F.col(value).isNotNull()).select(*keys, value)
    if drop <= 0:
        return usable.groupBy(*keys).agg(F.avg(value).alias("trimmed_mean"))
    tails = [2.0**-k for k in range(1, 13)]
    summary = F.percentile_approx(value, F.array(*[F.lit(1 - t) for t in tails]), int(2 / SHARE))
    stats = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), summary.alias("_marks"))
    bound = F.coalesce(*[F.when(F.lit(t - SHARE) * F.col("_rows") > drop, F.get("_marks", F.lit(k))) for k, t in reversed(list(enumerate(tails)))])
    high = usable.join(stats.select(*keys, bound.alias("_bound")), list(keys)).filter(F.col("_bound").isNull() | (F.col(value) >= F.col("_bound")))
    counted = high.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_size"))
    seen = F.sum("_size").over(W.partitionBy(*keys).orderBy(F.col(value).desc()))
    reached = counted.withColumn("_seen", seen).filter((F.col("_seen") >= drop) & (F.col("_seen") - F.col("_size") < drop))
    cuts = reached.select(*keys, F.col(value).alias("_cut"))
    v, cut = F.col(value), F.col("_cut")
    sums = usable.join(cuts, list(keys)).groupBy(*keys).agg(
        F.sum(F.when(v < cut, v)).alias("_low"), F.count_if(v == cut).alias("_at"), F.count_if(v > cut).alias("_gone"),
        F.count(F.lit(1)).alias("_n"), F.first("_cut").alias("_cut"),
    )
    stays = F.col("_at") - (F.lit(drop) - F.col("_gone"))
    total = F.coalesce(F.col("_low"), F.lit(0.0)) + F.when(stays > 0, stays * F.col("_cut")).otherwise(F.lit(0.0))
    return sums.filter(F.col("_n") > drop).select(*keys, (total / (F.col("_n") - drop)).alias("trimmed_mean"))


def forecast_slices(df, ranges, block: int, keys=KEYS, ts="ts") -> DataFrame:
    """Forecast and actual rows of the blocks [from, to) of each range, labelled ``from-to``."""
    indexed = index_rows(df, keys, ts)
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.col(RN) >= lo * block) & (F.col(RN) < hi * block), F.lit(f"{lo}-{hi}")
                )
                for lo, hi in ranges
            ]
        )
    )
    return indexed.select(*keys, ts, "actual", "pred", F.explode(hits).alias("horizon"))


def compare_forecasts(actuals, forecasts: dict[str, DataFrame], on=("series", "ts")) -> DataFrame:
    """Actuals with each model's forecast and error; a key that one of them lacks has NULL there."""
    out = actuals
    for name, frame in forecasts.items():
        out = out.join(frame.withColumnRenamed("pred", name), list(on), "full_outer")
    return out.withColumns({f"{name}_err": F.col(name) - F.col("actual") for name in forecasts})


def interval_table(mid, lower, upper, on=("series", "ts")) -> DataFrame:
    """Lower, middle and upper forecast next to the actual; a key that one of them lacks has NULL there."""
    low = lower.withColumnRenamed("pred", "lower")
    high = upper.withColumnRenamed("pred", "upper")
    return mid.join(low, list(on), "full_outer").join(high, list(on), "full_outer")

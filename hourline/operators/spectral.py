"""Fourier extrapolation and autocorrelation."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.operators.clean import drop_null_rows
from hourline.operators.segments import (
    CHUNK, HALO, RN, SIZE, chunk_window, index_rows, with_chunks,
)

KEYS = ("series",)
OUT_ROWS = 4096


def fourier_extrapolate(
    df, n_predict: int, n_harm=3, detrend=True, keys=KEYS, ts="ts", value="value"
) -> DataFrame:
    """(keys, pos, value): the series rebuilt from its lowest frequencies over n + n_predict points.

    The lowest 1 + 2 n_harm frequencies of a real series are the mean and n_harm cosine / sine
    pairs, so plain sums replace a transform of the whole vector: one partial aggregation. Detrending
    removes the least-squares slope (not the intercept) and is folded into the sums by linearity:
    sum((x - s t) cos) = sum(x cos) - s sum(t cos). A series of n points has the frequencies up to n / 2
    only; that of n / 2 itself stands alone and counts once. Rows without a value are left out first.
    """
    df = drop_null_rows(df, [value])
    t, x, n = F.col("_t"), F.col("_x"), F.col(SIZE)
    indexed = index_rows(df, keys, ts).select(*keys, SIZE, F.col(RN).cast("double").alias("_t"), F.col(value).alias("_x"))
    # the phase stays small: (k * t) mod n before the multiplication by 2 pi / n
    angles = {k: F.lit(2 * pi) * F.pmod(t * k, n.cast("double")) / n for k in range(1, n_harm + 1)}
    sums = {"x": x, "t": t, "tx": t * x, "tt": t * t}
    for k, a in angles.items():
        sums |= {f"xc{k}": x * F.cos(a), f"xs{k}": x * F.sin(a), f"tc{k}": t * F.cos(a), f"ts{k}": t * F.sin(a)}
    fit = indexed.groupBy(*keys, SIZE).agg(*[F.sum(e).alias(f"_{name}") for name, e in sums.items()])

    def s(name):
        return F.col(f"_{name}")

    slope = F.try_divide(n * s("tx") - s("t") * s("x"), n * s("tt") - s("t") * s("t"))
    model = fit.withColumn("_slope", F.coalesce(slope, F.lit(0.0)) if detrend else F.lit(0.0))
    weights = {}
    for k in angles:
        share = F.when(2 * k < n, 2 / n).when(2 * k == n, 1 / n).otherwise(F.lit(0.0))
        weights[f"_c{k}"] = share * (s(f"xc{k}") - s("slope") * s(f"tc{k}"))
        weights[f"_s{k}"] = share * (s(f"xs{k}") - s("slope") * s(f"ts{k}"))
    model = model.select(
        *keys, SIZE, "_slope", ((s("x") - s("slope") * s("t")) / n).alias("_mean"),
        *[weight.alias(name) for name, weight in weights.items()],
    )
    # two steps: starts of runs first, spread over the tasks, then the points of each run
    last = F.col(SIZE) + n_predict - 1
    starts = F.sequence(F.lit(0).cast("bigint"), last, F.lit(OUT_ROWS).cast("bigint"))
    runs = model.withColumn("_from", F.explode(starts)).repartition(*keys, "_from")
    points = runs.withColumn("pos", F.explode(F.sequence("_from", F.least(F.col("_from") + OUT_ROWS - 1, last))))
    # plain columns rather than an array, so that the sum is compiled
    wave = " + ".join(
        ["_mean", "_slope * pos"]
        + [
            f"_c{k} * cos({2 * pi!r}D * (pos * {k} % {SIZE}) / {SIZE}) + _s{k} * sin({2 * pi!r}D * (pos * {k} % {SIZE}) / {SIZE})"
            for k in angles
        ]
    )
    return points.select(*keys, "pos", F.expr(wave).alias("value"))


def acf(df, lags=48, keys=KEYS, ts="ts", value="value") -> DataFrame:
    """(keys, lag, acf) for lags 0..lags: the biased autocorrelation of consecutive rows.

    Rows without a value are left out first. Chunks of rows carry ``lags`` rows of the next chunk, and each lag is one column of a single
    window pass, so no row is multiplied by the number of lags.
    """
    wide = _acf_sums(df, lags, keys, ts, value)
    cells = F.array(*[F.col(f"_s{k}") for k in range(lags + 1)])
    return wide.select(*keys, F.posexplode(cells).alias("lag", "_s"), "_s0").select(
        *keys, "lag", F.try_divide("_s", "_s0").alias("acf")
    )


def _acf_sums(df, lags, keys, ts, value):
    indexed = index_rows(drop_null_rows(df, [value]), keys, ts, sums={"_sum": F.col(value)})
    centred = indexed.select(
        *keys, RN, SIZE, (F.col(value) - F.col("_sum") / F.col(SIZE)).alias("_d")
    )
    chunks = with_chunks(centred, 0, lags)
    order = chunk_window(keys)
    ahead = chunks.withColumns({f"_d{k}": F.lead("_d", k).over(order) for k in range(1, lags + 1)})
    own = ahead.filter(~F.col(HALO)).drop(CHUNK, HALO)
    return own.groupBy(*keys).agg(
        F.sum(F.col("_d") * F.col("_d")).alias("_s0"),
        *[F.coalesce(F.sum(F.col("_d") * F.col(f"_d{k}")), F.lit(0.0)).alias(f"_s{k}") for k in range(1, lags + 1)],
    )


def pacf(df, lags=48, keys=KEYS, ts="ts", value="value") -> DataFrame:
    """(keys, lag, pacf) for lags 0..lags by the Durbin-Levinson recursion on the biased ACF.

    The recursion runs over one array of lags + 1 numbers per series, inside Spark's ``aggregate``.
    """
    wide = _acf_sums(df, lags, keys, ts, value)
    rho = F.array(*[F.try_divide(f"_s{k}", "_s0") for k in range(lags + 1)])
    none = F.expr("cast(array() as array<double>)")

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)

    def step(state, k):
        phi, r = state["phi"], F.col("_rho")
        past = F.slice(r, F.lit(2), k - 1)
        top = F.element_at(r, k + 1) - dot(phi, F.reverse(past))
        new = F.try_divide(top, F.lit(1.0) - dot(phi, past))
        kept = F.zip_with(phi, F.reverse(phi), lambda a, b: a - new * b)
        return F.struct(
            F.concat(kept, F.array(new)).alias("phi"), F.array_append(state["out"], new).alias("out")
        )

    start = F.struct(none.alias("phi"), F.array(F.lit(1.0)).alias("out"))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(lags)), start, step)
    return wide.select(*keys, rho.alias("_rho")).select(
        *keys, F.posexplode(state["out"]).alias("lag", "pacf")
    )

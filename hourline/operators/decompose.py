"""Additive decomposition: piecewise-linear trend, Fourier seasonality and holidays.

The model family of Taylor and Letham (2018), fitted as a ridge regression per series: the prior
scale of each term group becomes its penalty. With ``sparse`` the trend's changes have the Laplace prior, an
absolute penalty, so that most of them are exactly zero. Fitting sums cross products (see ``linear``), so all
series, and all cutoffs of a cross-validation, are fitted in one distributed pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import pi
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourline.functions.dates import HOLIDAY_NAMES, epoch_second, holiday_name, hours_interval
from hourline.operators.cv import Z80, cutoff_count, cutoff_rows, cutoff_ts, training_interval
from hourline.operators.linear import cross_products, dot, solve, solve_running
from hourline.operators.segments import attach_series, attach_totals, segment_of

KEYS = ("series",)


@dataclass(frozen=True)
class Additive:
    """Terms and prior scales. ``seasons`` maps a name to (period in days, Fourier order)."""

    seasons: dict = field(default_factory=lambda: {"yearly": (365.25, 10), "weekly": (7.0, 3)})
    changepoints: int = 25
    changepoint_range: float = 0.8
    changepoint_prior_scale: float = 0.05
    seasonality_prior_scale: float = 10.0
    holidays_prior_scale: float = 10.0
    holidays: bool = True
    noise: float = 0.1
    sparse: bool = False

    def groups(self) -> dict[str, int]:
        """Width of each term group, in design order."""
        widths = {"trend": 2 + self.changepoints}
        widths |= {name: 2 * order for name, (_, order) in self.seasons.items()}
        return widths | ({"holidays": len(HOLIDAY_NAMES)} if self.holidays else {})

    def penalty(self) -> list[float]:
        """Noise variance over prior variance; offset and growth have the wide scale 5."""
        scales = [5.0, 5.0] + [float("inf") if self.sparse else self.changepoint_prior_scale] * self.changepoints
        scales += [self.seasonality_prior_scale] * sum(2 * o for _, o in self.seasons.values())
        scales += [self.holidays_prior_scale] * (len(HOLIDAY_NAMES) if self.holidays else 0)
        return [self.noise ** 2 / s ** 2 for s in scales]

    def lasso(self) -> list[float]:
        """Noise variance over the Laplace prior's scale, for the trend's changes of a ``sparse`` model."""
        weights = [0.0] * len(self.penalty())
        if self.sparse:
            weights[2 : 2 + self.changepoints] = [self.noise ** 2 / self.changepoint_prior_scale] * self.changepoints
        return weights


def design(df, model: Additive, ts="ts") -> DataFrame:
    """Adds ``x``, the design row; needs ``_first`` and ``_last`` (the history range) on each row."""
    span = epoch_second(F.col("_last")) - epoch_second(F.col("_first"))
    t = F.try_divide(epoch_second(F.col(ts)) - epoch_second(F.col("_first")), span)
    t = F.coalesce(t, F.lit(0.0))
    days = epoch_second(F.col(ts)) / F.lit(86400.0)
    # SQL text, because some sixty terms built as column objects take seconds to assemble
    terms = ["1.0D", "_t"]
    for j in range(1, model.changepoints + 1):
        terms.append(f"greatest(_t - {model.changepoint_range * j / model.changepoints!r}D, 0.0D)")
    for period, order in model.seasons.values():
        for k in range(1, order + 1):
            terms += [f"{wave}({2 * pi * k / period!r}D * _days)" for wave in ("cos", "sin")]
    out = df.withColumns({"_t": t, "_days": days})
    if model.holidays:
        out = out.withColumn("_ds", F.to_date(ts)).withColumn("_holiday", holiday_name("_ds")).drop("_ds")
        terms += [f'CAST(_holiday <=> "{name}" AS DOUBLE)' for name in HOLIDAY_NAMES]
    return out.withColumn("x", F.expr(f"array({', '.join(terms)})")).drop("_t", "_days", "_holiday")


def future_frame(df, periods: int, step_hours=1, keys=KEYS, ts="ts") -> DataFrame:
    """(keys, ts): the history stamps followed by ``periods`` more, ``step_hours`` apart."""
    history = df.select(*keys, ts)
    return history.unionByName(future_rows(df, periods, step_hours, keys, ts)) if periods else history


def future_rows(df, periods: int, step_hours=1, keys=KEYS, ts="ts") -> DataFrame:
    """(keys, ts): the ``periods`` stamps after the last one of each series."""
    last = df.groupBy(*keys).agg(F.max(ts).alias("_end"))
    step = hours_interval(step_hours)
    ahead = F.sequence(F.col("_end") + step, F.col("_end") + hours_interval(step_hours * periods), step)
    return last.select(*keys, F.explode(ahead).alias(ts))


def _predict(scored, model: Additive, keep) -> DataFrame:
    """``keep``, the component columns, their sum and its bounds, from ``x`` and the fit of the row."""
    parts, at = [], 0
    for name, width in model.groups().items():
        parts.append((dot("x", "coef", at, width) * F.col("_scale")).alias(name))
        at += width
    sigma = F.sqrt(F.col("rss") / F.col("n")) * F.col("_scale")
    yhat = reduce(add, [F.col(name) for name in model.groups()])
    return (
        scored.select(*keep, *parts, sigma.alias("_sigma"))
        .withColumn("yhat", yhat)
        .withColumns({"yhat_lower": F.col("yhat") - Z80 * F.col("_sigma"), "yhat_upper": F.col("yhat") + Z80 * F.col("_sigma")})
        .drop("_sigma")
    )


def fitted(
    df, model: Additive, periods=0, step_hours=1, keys=KEYS, ts="ts", value="value"
) -> tuple[DataFrame, DataFrame]:
    """(rows, fit): history and ``periods`` more stamps with their design ``x`` and ``_scale``, and the coefficients of each series."""
    observed = df.filter(F.col(value).isNotNull()).select(*keys, ts, value)
    frame = observed
    if periods:
        ahead = future_rows(observed, periods, step_hours, keys, ts)
        frame = observed.unionByName(ahead, allowMissingColumns=True)
    stamp = F.when(F.col(value).isNotNull(), F.col(ts))
    ranged = attach_totals(
        frame, keys, ts, mins={"_first": stamp}, maxs={"_last": stamp, "_peak": F.abs(value)}
    )
    scaled = ranged.withColumn("_scale", F.when(F.col("_peak") > 0, F.col("_peak")).otherwise(F.lit(1.0)))
    rows = design(scaled, model, ts)
    train = rows.filter(F.col(value).isNotNull()).withColumn("y", F.col(value) / F.col("_scale"))
    return rows, solve(cross_products(train, keys), keys, model.penalty(), model.lasso())


def decompose(
    df, model: Additive | None = None, periods=0, step_hours=1, keys=KEYS, ts="ts", value="value"
) -> DataFrame:
    """(keys, ts, value, <components>, yhat, yhat_lower, yhat_upper) in sample and ``periods`` ahead.

    Future rows have a NULL value. Bounds are the central 80 % of the residual spread.
    """
    model = model or Additive()
    rows, fit = fitted(df, model, periods, step_hours, keys, ts, value)
    scored = attach_series(rows, fit, keys, segment_of(ts))
    return _predict(scored, model, [*keys, ts, value])


def _uniform(*parts) -> Column:
    """A number between 0 and 1 that follows from the parts' text: a rerun gives the same ones."""
    head = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / F.lit(2.0**32)


def trend_paths(
    df, model: Additive | None = None, periods=168, step_hours=1, paths=200, low=0.1, high=0.9, keys=KEYS, ts="ts", value="value"
) -> DataFrame:
    """(keys, ts, step, yhat, yhat_lower, yhat_upper) of ``periods`` future steps, with bounds that widen.

    Future trends change as the fitted one did: on each path a step has a change with the fitted rate of changes, of a size drawn from
    a Laplace distribution with the fitted changes' mean size. Noise with the residual spread is added, and the bounds are quantiles
    over the ``paths``, exact ones, as a stamp has one value from each. All draws are hashes of (keys, path, step). A path is one group of ``periods``
    rows.
    """
    model, keys = model or Additive(), list(keys)
    rows, fit = fitted(df, model, periods, step_hours, keys, ts, value)
    ahead = rows.filter(F.col(value).isNull() & (F.col(ts) > F.col("_last")))
    scored = attach_series(ahead, fit, keys, segment_of(ts))
    changes = F.slice("coef", 3, model.changepoints)
    size = F.aggregate(changes, F.lit(0.0), lambda t, c: t + F.abs(c)) / F.lit(float(max(1, model.changepoints)))
    span = epoch_second(F.col("_last")) - epoch_second(F.col("_first"))
    dt = F.lit(step_hours * 3600.0) / span
    since = epoch_second(F.col(ts)) - epoch_second(F.col("_last"))
    yhat = dot("x", "coef", 0, len(model.penalty())) * F.col("_scale")
    steps = scored.select(
        *keys, ts, F.round(since / F.lit(step_hours * 3600)).cast("bigint").alias("step"), yhat.alias("yhat"), "_scale",
        size.alias("_size"), dt.alias("_dt"), F.sqrt(F.col("rss") / F.col("n")).alias("_sigma"), F.explode(F.sequence(F.lit(1), F.lit(paths))).alias("_path"),
    )
    draw = [_uniform(*[F.col(k) for k in keys], F.col("_path"), F.col("step"), F.lit(i)) for i in range(4)]
    side = draw[1] - 0.5
    change = F.when(draw[0] < F.lit(float(model.changepoints)) * F.col("_dt"), -F.col("_size") * F.signum(side) * F.log(1 - 2 * F.abs(side))).otherwise(0.0)
    noise = F.col("_sigma") * F.sqrt(-2 * F.log(draw[2])) * F.cos(F.lit(2 * pi) * draw[3])
    path = W.partitionBy(*keys, "_path").orderBy("step")
    before = path.rowsBetween(W.unboundedPreceding, -1)
    slopes = steps.withColumns({"_change": change, "_noise": noise}).withColumn("_slope", F.sum("_change").over(path))
    off = F.coalesce(F.sum(F.col("_slope") * F.col("_dt")).over(before), F.lit(0.0))  # a change tells from the next step on
    drawn = slopes.withColumn("_drawn", F.col("yhat") + F.col("_scale") * (off + F.col("_noise")))
    return drawn.groupBy(*keys, ts, "step").agg(
        F.first("yhat").alias("yhat"), F.percentile("_drawn", low).alias("yhat_lower"), F.percentile("_drawn", high).alias("yhat_upper")
    )


def cross_validate(
    df, initial_hours: int, period_hours: int, horizon_hours: int, model: Additive | None = None,
    keys=KEYS, ts="ts", value="value",
) -> DataFrame:
    """(keys, cutoff, ts, actual, pred, lower, upper): the additive model at every rolling origin.

    Cross products are summed once per stretch between two cutoffs; a running sum over the stretches
    gives the products of all rows up to each cutoff. All cutoffs cost one pass over the data.
    """
    model = model or Additive()
    spec = (initial_hours, period_hours, horizon_hours)
    stamp = F.col(ts)
    ranged = attach_totals(
        df.filter(F.col(value).isNotNull()).select(*keys, ts, value), keys, ts,
        mins={"_first": stamp}, maxs={"_last": stamp},
    )
    # the y scale comes from the initial window only, which every cutoff may see
    early = stamp <= F.col("_first") + hours_interval(initial_hours)
    peak = ranged.groupBy(*keys).agg(F.max(F.when(early, F.abs(value))).alias("_peak"))
    peak = peak.select(*keys, F.when(F.col("_peak") > 0, F.col("_peak")).otherwise(F.lit(1.0)).alias("_scale"))
    rows = attach_series(design(ranged, model, ts), peak, keys, segment_of(ts))
    train = rows.withColumn("_k", training_interval(ts, *spec)).filter(F.col("_k") >= 0)
    train = train.withColumn("y", F.col(value) / F.col("_scale"))
    products = cross_products(train, [*keys, "_k"])
    series = ranged.groupBy(*keys).agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    cuts = series.select(
        *keys, "_last", F.explode(F.sequence(F.lit(0).cast("bigint"), cutoff_count(*spec) - 1)).alias("_k")
    )
    fit = solve_running(products, keys, "_k", model.penalty(), cuts, model.lasso())
    ahead = rows.withColumn("_k", F.explode(cutoff_rows(ts, *spec)))
    scored = ahead.join(fit, [*keys, "_k"])
    cutoff = cutoff_ts(F.col("_k"), period_hours, horizon_hours).alias("cutoff")
    out = _predict(scored, model, [*keys, cutoff, ts, F.col(value).alias("actual")])
    return out.select(
        *keys, "cutoff", ts, "actual", F.col("yhat").alias("pred"),
        F.col("yhat_lower").alias("lower"), F.col("yhat_upper").alias("upper"),
    )

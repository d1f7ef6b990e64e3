"""Min-max scaling and centring, fitted on one part and applied to all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.operators.clean import fill_zero
from hourline.operators.segments import attach_totals
from hourline.operators.splits import walk_forward_rows

KEYS = ("series",)


def _scaler_state(df, columns, fit, keys, ts):
    return attach_totals(
        df, keys, ts,
        mins={f"{c}_min": F.when(fit, F.col(c)) for c in columns},
        maxs={f"{c}_max": F.when(fit, F.col(c)) for c in columns},
    )


def _width(column):
    span = F.col(f"{column}_max") - F.col(f"{column}_min")
    return F.when(span == 0, F.lit(1.0)).otherwise(span)


def minmax_scale(df, columns, fit, keys=KEYS, ts="ts", keep_state=False) -> DataFrame:
    """Scale by the minimum and maximum of the rows where ``fit`` holds; other rows may leave [0, 1].

    A constant column becomes 0. ``keep_state`` leaves ``<col>_min`` / ``<col>_max`` for the inverse.
    """
    state = _scaler_state(df, columns, fit, keys, ts)
    out = state.withColumns({c: (F.col(c) - F.col(f"{c}_min")) / _width(c) for c in columns})
    return out if keep_state else out.select(*df.columns)


def minmax_inverse(df, target: str, column: str) -> DataFrame:
    """Undo the scaling of ``column`` with the kept state of ``target``."""
    return df.withColumn(column, F.col(column) * _width(target) + F.col(f"{target}_min"))


def center_series(
    df, horizon_hours: int, step_hours=1, log1p=False, keys=KEYS, ts="ts", value="value"
) -> DataFrame:
    """Walk-forward rows minus the mean of the *encode* rows of their own split.

    With ``log1p``, NULL and NaN count as 0 and log1p is taken before centring.
    """
    base = fill_zero(df, value).withColumn(value, F.log1p(value)) if log1p else df
    rows = walk_forward_rows(base, horizon_hours, step_hours, keys, ts)
    encode = F.when(F.col("part") == "encode", F.col(value))
    centred = attach_totals(
        rows, [*keys, "split"], ts,
        sums={"_sum": encode, "_cnt": F.when(encode.isNotNull(), 1).otherwise(0)},
    )
    mean = F.try_divide(F.col("_sum"), F.col("_cnt"))
    return centred.withColumn("encode_mean", mean).withColumn(
        value, F.col(value) - F.col("encode_mean")
    ).select(*keys, ts, "split", "part", value, "encode_mean")

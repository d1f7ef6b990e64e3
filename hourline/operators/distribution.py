"""Fixed-width histograms in one and two dimensions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourline.operators.segments import SIZE, attach_raw_totals

KEYS = ("series",)


def _bin(column: str, bins: int) -> Column:
    """1-based bin; the maximum belongs to the last bin, and a constant column to the first."""
    low, high = F.col(f"_lo_{column}"), F.col(f"_hi_{column}")
    bucket = F.width_bucket(F.col(column), low, high, F.lit(bins))
    return F.when(low == high, 1).otherwise(F.least(bucket, F.lit(bins)))


def _with_limits(df, columns, keys, ts):
    return attach_raw_totals(
        df.select(*keys, ts, *columns), keys, ts,
        mins={f"_lo_{c}": F.col(c) for c in columns},
        maxs={f"_hi_{c}": F.col(c) for c in columns},
    )


def _finite(df, columns):
    """Rows with a number in each column: NULL, NaN and infinities have no bin."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df


def histogram_rejects(df, columns, keys=KEYS) -> DataFrame:
    """(keys, n): rows that the histogram of ``columns`` leaves out."""
    bad = reduce(or_, [F.col(c).isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))) for c in columns])
    return df.groupBy(*keys).agg(F.count_if(bad).alias("n"))


def histogram(df, column="value", bins=25, density=False, keys=KEYS, ts="ts") -> DataFrame:
    """(keys, bin, low, high, n) over the bins that hold rows; ``density`` divides by n and width."""
    ranged = _with_limits(_finite(df, [column]), [column], keys, ts)
    limits = [f"_lo_{column}", f"_hi_{column}", SIZE]
    counted = ranged.groupBy(*keys, _bin(column, bins).alias("bin"), *limits).agg(
        F.count(F.lit(1)).alias("n")
    )
    low = F.col(limits[0])
    width = (F.col(limits[1]) - low) / bins
    out = counted.select(
        *keys, "bin", (low + (F.col("bin") - 1) * width).alias("low"), (low + F.col("bin") * width).alias("high"),
        "n", F.try_divide(F.col("n"), F.col(SIZE) * width).alias("density"),
    )
    return out if density else out.drop("density")


def hist2d(df, x: str, y: str, x_bins=10, y_bins=50, keys=KEYS, ts="ts") -> DataFrame:
    """(keys, x_bin, y_bin, n): the joint distribution as counts of occupied cells."""
    ranged = _with_limits(_finite(df, [x, y]), [x, y], keys, ts)
    return ranged.groupBy(*keys, _bin(x, x_bins).alias("x_bin"), _bin(y, y_bins).alias("y_bin")).agg(
        F.count(F.lit(1)).alias("n")
    )

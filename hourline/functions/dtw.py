"""Dynamic time warping with a band, and the LB_Keogh lower bound.

The numpy helpers work on a whole Arrow batch at once: the loops run over time steps, never rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dtw_batch(a: np.ndarray, b: np.ndarray, w: int) -> np.ndarray:
    """Distances between the rows of ``a`` (rows x n) and ``b`` (rows x m, or one row for all).

    Step i may meet steps i - w up to but not including i + w; the band is at least |n - m|. Squared
    step cost, square root of the total; infinite when the band never reaches the end.
    """
    n, m = a.shape[1], b.shape[1]
    w = max(w, abs(n - m))
    above = np.full((len(a), m + 1), np.inf)
    above[:, 0] = 0.0
    for i in range(n):
        here = np.full((len(a), m + 1), np.inf)
        for j in range(max(0, i - w), min(m, i + w)):
            best = np.minimum(np.minimum(above[:, j + 1], here[:, j]), above[:, j])
            here[:, j + 1] = (a[:, i] - b[:, j]) ** 2 + best
        above = here
    return np.sqrt(above[:, m])


def align_batch(a: np.ndarray, b: np.ndarray, w: int) -> np.ndarray:
    """(rows x m) sums and counts, stacked, of the steps of each row of ``a`` that the cheapest path joins to each step of the vector ``b``."""
    n, m, k = a.shape[1], len(b), len(a)
    w = max(w, abs(n - m))
    cost = np.full((k, n + 1, m + 1), np.inf)
    cost[:, 0, 0] = 0.0
    for i in range(n):
        for j in range(max(0, i - w), min(m, i + w)):
            before = np.minimum(np.minimum(cost[:, i, j + 1], cost[:, i + 1, j]), cost[:, i, j])
            cost[:, i + 1, j + 1] = (a[:, i] - b[j]) ** 2 + before
    sums, rows = np.zeros((2, k, m)), np.arange(k)
    i, j = np.full(k, n), np.full(k, m)
    open_ = np.isfinite(cost[:, n, m])
    while open_.any():
        at = rows[open_]
        np.add.at(sums, (0, at, j[at] - 1), a[at, i[at] - 1])
        np.add.at(sums, (1, at, j[at] - 1), 1.0)
        steps = np.stack([cost[at, i[at] - 1, j[at] - 1], cost[at, i[at] - 1, j[at]], cost[at, i[at], j[at] - 1]])
        way = steps.argmin(axis=0)  # both back, the first on ties
        i[at], j[at] = i[at] - (way != 2), j[at] - (way != 1)
        open_[at] = (i[at] > 0) & (j[at] > 0)
    return sums


def keogh_batch(a: np.ndarray, centre: np.ndarray, r: int) -> np.ndarray:
    """LB_Keogh of each row of ``a`` against one vector; the envelope at i spans [i - r, i + r)."""
    spans = [centre[max(0, i - r): i + r] for i in range(a.shape[1])]
    low = np.array([s.min() for s in spans])
    high = np.array([s.max() for s in spans])
    over = np.clip(a - high, 0, None) + np.clip(low - a, 0, None)
    return np.sqrt((over ** 2).sum(axis=1))


def dtw_distance(a: Column, b: Column, w: int = 4) -> Column:
    """Banded DTW between two array columns."""

    @F.pandas_udf("double")
    def distance(left: pd.Series, right: pd.Series) -> pd.Series:
        sizes = pd.DataFrame({"n": left.map(len), "m": right.map(len)})
        out = pd.Series(np.nan, index=left.index)
        for _, rows in sizes.groupby(["n", "m"]).groups.items():
            out[rows] = dtw_batch(np.stack(left[rows]), np.stack(right[rows]), w)
        return out

    return distance(a, b)


def nearest_centroid(shape: Column, centroids: list[list[float]], w: int = 4, r: int = 5) -> Column:
    """STRUCT<cluster, dist>: the centroid with the smallest DTW distance, the first one on ties.

    DTW runs only for rows whose lower bound beats the best distance so far; the bound holds only if
    its envelope is as wide as the band, so ``r`` must be ``w`` or more. The centroids travel in the
    function: k vectors of one shape's length. A shape that is NULL, of another length, or holds a
    NULL or NaN has no nearest centroid (both fields NULL).
    """
    if r < w:
        raise ValueError(f"the envelope r = {r} must be at least the band w = {w}")
    centres = np.asarray(centroids, dtype=float)

    @F.pandas_udf("cluster int, dist double")
    def assign(shapes: pd.Series) -> pd.DataFrame:
        whole = shapes.map(lambda s: s is not None and len(s) == centres.shape[1])
        usable = np.flatnonzero(whole & shapes.where(whole, None).map(lambda s: s is not None and bool(np.isfinite(np.asarray(s, dtype=float)).all())))
        out = pd.DataFrame({"cluster": pd.array([None] * len(shapes), dtype="Int32"), "dist": pd.array([None] * len(shapes), dtype="Float64")})
        if not len(usable):
            return out
        x = np.stack([np.asarray(s, dtype=float) for s in shapes.iloc[usable]])
        best = np.full(len(x), np.inf)
        cluster = np.full(len(x), -1, dtype=np.int32)
        for c, centre in enumerate(centres):
            open_rows = np.flatnonzero(keogh_batch(x, centre, r) < best)
            if len(open_rows) == 0:
                continue
            dist = dtw_batch(x[open_rows], centre[None, :], w)
            closer = dist < best[open_rows]
            best[open_rows[closer]] = dist[closer]
            cluster[open_rows[closer]] = c
        out.loc[usable, "cluster"], out.loc[usable, "dist"] = cluster, best
        return out

    return assign(shape)


def lb_keogh(a: Column, b: Column, r: int = 5) -> Column:
    """LB_Keogh between two array columns of equal length, as built-in array functions."""

    def over(x, i):
        first = F.greatest(i - r, F.lit(0))
        span = F.slice(b, first + 1, F.least(i + r, F.size(b)) - first)
        return F.greatest(x - F.array_max(span), F.array_min(span) - x, F.lit(0.0))

    total = F.aggregate(F.transform(a, over), F.lit(0.0), lambda t, x: t + x * x)
    return F.sqrt(total)

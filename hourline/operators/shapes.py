"""Weekly load shapes and their clustering by dynamic time warping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourline.functions.dtw import align_batch, dtw_distance, lb_keogh, nearest_centroid
from hourline.operators.calendar import holiday_flags

KEYS = ("series",)


def _week(ts, iso_year):
    """Calendar year with ISO week (as the source data model has it), or the true ISO year."""
    thursday = F.date_add(F.to_date(ts), 3 - F.weekday(ts))
    return (F.year(thursday) if iso_year else F.year(ts)), F.weekofyear(ts)


def week_off_hours(df, keys=KEYS, ts="ts", iso_year=False, holidays=None) -> DataFrame:
    """Every row with year, ISO week and the number of weekend or holiday rows in that week."""
    year, week = _week(ts, iso_year)
    flagged = holiday_flags(df, holidays, ts).withColumns({"year": year, "week": week})
    in_week = W.partitionBy(*keys, "year", "week")
    return flagged.withColumn("off_hours", F.sum("off_flag").over(in_week)).drop("holiday_flag")


def weekly_shapes(
    df, length=168, off_units=48, keys=KEYS, ts="ts", value="value", iso_year=False, holidays=None
) -> DataFrame:
    """(keys, year, week, shape): complete weeks with exactly ``off_units`` off rows.

    One aggregation by week; a group holds one calendar week of one series.
    """
    year, week = _week(ts, iso_year)
    flagged = holiday_flags(df, holidays, ts)
    cells = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))))
    weeks = flagged.groupBy(*keys, year.alias("year"), week.alias("week")).agg(
        F.sum("off_flag").alias("_off"), cells.alias("_cells")
    )
    shaped = weeks.withColumn("shape", F.transform("_cells", lambda c: c["v"]))
    return complete_weeks(shaped.filter(F.col("_off") == off_units), length).select(*keys, "year", "week", "shape")


def daily_shapes(df, length=24, keys=KEYS, ts="ts", value="value") -> DataFrame:
    """(keys, year, day, shape): days with a value at every step; ``day`` is that of the year."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))))
    days = df.groupBy(*keys, F.year(ts).alias("year"), F.dayofyear(ts).alias("day")).agg(cells.alias("_cells"))
    shaped = days.withColumn("shape", F.transform("_cells", lambda c: c["v"]))
    return complete_weeks(shaped, length).select(*keys, "year", "day", "shape")


def complete_weeks(shapes, length: int, shape="shape") -> DataFrame:
    """Shapes of the full length without a missing value."""
    return shapes.filter((F.size(shape) == length) & ~F.exists(shape, lambda v: v.isNull() | F.isnan(v)))


def week_pairs(shapes, keys=KEYS) -> DataFrame:
    """Each shape next to the following shape of its series (``shape``, ``next_shape``).

    Shapes are one row per week, so a series has at most 53 of them a year.
    """
    order = W.partitionBy(*keys).orderBy("year", "week")
    paired = shapes.withColumn("next_shape", F.lead("shape").over(order))
    return paired.filter(F.col("next_shape").isNotNull())


def dtw_pairs(pairs, a="shape", b="next_shape", w=4) -> DataFrame:
    """Adds ``dtw`` for the two shapes of each row."""
    return pairs.withColumn("dtw", dtw_distance(F.col(a), F.col(b), w))


def lb_pairs(pairs, a="shape", b="next_shape", r=5) -> DataFrame:
    """Adds the lower bound ``lb`` for the two shapes of each row."""
    return pairs.withColumn("lb", lb_keogh(F.col(a), F.col(b), r))


def seed_centroids(shapes, k: int, keys=KEYS) -> list[list[float]]:
    """k starting shapes in the order of a hash of their key: the same whatever the row order."""
    key = F.md5(F.concat_ws("|", *keys, "year", "week"))
    return [list(row["shape"]) for row in shapes.orderBy(key, *keys, "year", "week").limit(k).collect()]


def dtw_kmeans(shapes, k=4, iters=100, w=4, r=5, keys=KEYS, barycentres=False) -> tuple[DataFrame, DataFrame]:
    """(assignments, centroids) of k-means under DTW.

    Each round assigns every shape to its nearest centroid in one pass without a shuffle, then
    averages each position over the members. Such means need not lower the distances, so the centroids may
    go round without end; ``barycentres`` averages the steps that the cheapest paths join to a position (Petitjean et al., 2011), which
    does lower them, until nothing moves. Only the k centroids come back to the driver, so the
    plan does not grow with the rounds and nothing needs a checkpoint: a lost executor recomputes
    its shapes from the source. A centroid without members stays where it is. The envelope r must be at
    least the band w. A shape that can't be compared has a NULL cluster. Stops early when the
    centroids no longer move or were there before. The returned assignments are those the last update was made from.
    """
    shapes = shapes.persist()
    try:
        centroids = seed_centroids(shapes, k, keys)
        used, seen = centroids, set()
        for _ in range(iters if centroids else 0):
            used = centroids
            assigned = assign_clusters(shapes, used, w, r)
            means = barycentre_shapes(assigned, used, w) if barycentres else mean_shapes(assigned)
            moved = {row["cluster"]: list(row["centroid"]) for row in means.collect()}
            centroids = [moved.get(c, used[c]) for c in range(len(used))]
            state = tuple(float(f"{v:.9e}") for centre in centroids for v in centre)
            if state in seen or np.allclose(centroids, used, rtol=1e-12, atol=0.0):
                break
            seen.add(state)
    finally:
        shapes.unpersist()
    spark = shapes.sparkSession
    table = spark.createDataFrame(
        [(c, centre) for c, centre in enumerate(centroids)], "cluster int, centroid array<double>"
    )
    return assign_clusters(shapes, used, w, r), table


def assign_clusters(shapes, centroids, w=4, r=5) -> DataFrame:
    if not centroids:  # no shapes
        return shapes.withColumns({"cluster": F.lit(None).cast("int"), "dist": F.lit(None).cast("double")})
    nearest = nearest_centroid(F.col("shape"), centroids, w, r)
    return shapes.withColumn("_near", nearest).select("*", "_near.cluster", "_near.dist").drop("_near")


def mean_shapes(assigned) -> DataFrame:
    """(cluster, centroid): the mean of the members at each position, by partial aggregation."""
    cells = assigned.filter(F.col("cluster") >= 0).select("cluster", F.posexplode("shape").alias("pos", "v"))
    means = cells.groupBy("cluster", "pos").agg(F.avg("v").alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return means.groupBy("cluster").agg(F.transform(ordered, lambda c: c["v"]).alias("centroid"))


def barycentre_shapes(assigned, centroids, w=4) -> DataFrame:
    """(cluster, centroid): the mean, at each position, of the members' steps that the cheapest path joins to it."""
    centres = [np.asarray(c, dtype=float) for c in centroids]

    def paths(batches):
        for batch in batches:
            cluster = batch.column(0).to_numpy(zero_copy_only=False)
            for c in np.unique(cluster):
                x = np.stack([v.values.to_numpy(zero_copy_only=False) for v in batch.column(1).take(pa.array(np.flatnonzero(cluster == c)))])
                sums, counts = align_batch(x, centres[c], w).sum(axis=1)
                columns = [pa.array(np.full(len(sums), c), pa.int32()), pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, names=["cluster", "pos", "s", "n"])

    cells = assigned.filter(F.col("cluster") >= 0).select("cluster", "shape").mapInArrow(paths, "cluster INT, pos INT, s DOUBLE, n DOUBLE")
    means = cells.groupBy("cluster", "pos").agg((F.sum("s") / F.sum("n")).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return means.groupBy("cluster").agg(F.transform(ordered, lambda c: c["v"]).alias("centroid"))


def cluster_weeks(assigned, weeks, keys=KEYS) -> DataFrame:
    """Assignments joined to the week table on (keys, year, week)."""
    on = [*keys, "year", "week"]
    return assigned.select(*on, "cluster").join(weeks, on)


def cluster_calendar(assigned) -> DataFrame:
    """How often each ISO week of the year falls in each cluster."""
    return assigned.groupBy("week", "cluster").agg(F.count(F.lit(1)).alias("weeks"))


def unassigned(shapes, assigned, keys=KEYS) -> DataFrame:
    """Weeks without an assignment."""
    return shapes.join(assigned.filter(F.col("cluster") >= 0), [*keys, "year", "week"], "left_anti")

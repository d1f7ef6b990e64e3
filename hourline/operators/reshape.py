"""Wide to long, long to wide, and ordered arrays of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.functions.parse import date_hour_ts, parse_ts, segment_hour
from hourline.operators.segments import RN, index_rows

SEGMENT_LABELS = [f"seg_{n}" for n in range(4, 100)]


def melt_segments(df, ids=("Type", "Date"), value="Load") -> DataFrame:
    """Every other column becomes a row; NULL cells are kept."""
    rest = [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), rest, "Segment", value)


def melt(df, ids, label="label", value="value") -> DataFrame:
    """Every column but ``ids`` becomes a row with its name and value; NULL cells are kept."""
    return df.unpivot(list(ids), [c for c in df.columns if c not in ids], label, value)


def melt_dates(df, ids, fmt: str, ts="ts", label="label", value="value") -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of a matrix whose column names are stamps.

    Good rows are (ids, ts, value). Rejects are the cells whose column name isn't a stamp of the format,
    as (ids, label, value).
    """
    long = melt(df, ids, label, value).withColumn(ts, parse_ts(F.col(label), fmt))
    return long.filter(F.col(ts).isNotNull()).select(*ids, ts, value), long.filter(F.col(ts).isNull()).select(*ids, label, value)


def segments_to_hourly(df, ids=("Type",), date="Date", value="Load") -> DataFrame:
    """Long quarter-hour profile to hourly means: label to hour, date and hour to stamp, average."""
    stamped = df.filter(F.col(value).isNotNull()).select(
        *ids, date_hour_ts(F.col(date), segment_hour(F.col("Segment"))).alias("ts"), value
    )
    return stamped.groupBy(*ids, "ts").agg(F.avg(value).alias(value))


def long_mean(df, index, column, value) -> DataFrame:
    """The pivot table kept long: one mean per (index, column) cell, for unbounded column sets."""
    return df.groupBy(*index, column).agg(F.avg(value).alias(value))


def pivot_mean(df, index, column, labels, value) -> DataFrame:
    """Pivot with mean for a small column set known in advance (one pass, no scan for labels)."""
    return df.groupBy(*index).pivot(column, list(labels)).agg(F.avg(value))


def common_timestamps(df, keys=("series",), ts="ts") -> DataFrame:
    """Rows whose timestamp has a value in every series.

    Counting is pre-aggregated to (series, ts) and then ts on the map side. The number of series is
    a scalar subquery; the surviving stamps are bounded by the time span.
    """
    n_series = df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n"))
    per_ts = (
        df.select(*keys, ts).distinct().groupBy(ts).agg(F.count(F.lit(1)).alias("_k"))
        .filter(F.col("_k") == n_series.scalar()).select(ts)
    )
    return df.join(per_ts, ts, "left_semi")


def series_arrays(df, keys=("series",), ts="ts", value="value", block=1024) -> DataFrame:
    """The series as ordered arrays of at most ``block`` values: (keys, block, start, values).

    A whole series is the concatenation of its blocks in order; no row holds an unbounded array.
    """
    indexed = index_rows(df, keys, ts)
    cells = F.array_sort(F.collect_list(F.struct(F.col(RN).alias("pos"), F.col(value).alias("v"))))
    return (
        indexed.groupBy(*keys, F.floor(F.col(RN) / block).alias("block"))
        .agg(cells.alias("_cells"))
        .select(
            *keys,
            "block",
            (F.col("block") * block).alias("start"),
            F.transform("_cells", lambda c: c["v"]).alias("values"),
        )
    )


def explode_arrays(blocks, keys=("series",), values="values", start="start") -> DataFrame:
    """(keys, pos, value): the inverse of ``series_arrays``."""
    return blocks.select(*keys, start, F.posexplode(values).alias("_i", "value")).select(
        *keys, (F.col(start) + F.col("_i")).alias("pos"), "value"
    )

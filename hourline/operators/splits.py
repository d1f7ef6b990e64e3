"""Train, validation and test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.functions.dates import hours_interval
from hourline.operators.segments import RN, SIZE, attach_totals, index_rows

KEYS = ("series",)


def label_year(df, test_year: int, ts="ts") -> DataFrame:
    """Adds ``split``: 'test' for the test year, 'train' for all others (also later ones)."""
    return df.withColumn("split", F.when(F.year(ts) == test_year, "test").otherwise("train"))


def split_by_index(df, bounds: dict[str, tuple[int, int | None]], keys=KEYS, ts="ts") -> DataFrame:
    """Positional ranges per series; ``bounds`` maps a name to [first, last], last None = the end.

    Rows outside every range drop out.
    """
    label = F.coalesce(
        *[
            F.when((F.col(RN) >= lo) & (F.lit(True) if hi is None else F.col(RN) <= hi), F.lit(name))
            for name, (lo, hi) in bounds.items()
        ]
    )
    return (
        index_rows(df, keys, ts).withColumn("split", label).filter(F.col("split").isNotNull()).drop(SIZE)
    )


def split_tail(df, n: int, keys=KEYS, ts="ts", names=("train", "val")) -> DataFrame:
    """The last n rows of each series are validation, the others training."""
    head, tail = names
    label = F.when(F.col(RN) >= F.col(SIZE) - n, tail).otherwise(head)
    return index_rows(df, keys, ts).withColumn("split", label).drop(RN, SIZE)


def train_test_split(df, test_year: int, val_num: int, keys=KEYS, ts="ts") -> DataFrame:
    """One ``split`` column: test year, last ``val_num`` training rows as val, the rest train."""
    labelled = label_year(df, test_year, ts).withColumnRenamed("split", "_part")
    # the tail is counted among the training rows only
    train = split_tail(labelled.filter(F.col("_part") == "train"), val_num, keys, ts)
    test = labelled.filter(F.col("_part") == "test").withColumn("split", F.lit("test"))
    return train.drop("_part").unionByName(test.drop("_part"))


def context_test_set(df, test_year: int, n: int, keys=KEYS, ts="ts") -> DataFrame:
    """The test year, preceded by the last n training rows as context (``role`` tells them apart)."""
    labelled = label_year(df, test_year, ts)
    context = (
        split_tail(labelled.filter(F.col("split") == "train").drop("split"), n, keys, ts)
        .filter(F.col("split") == "val").withColumn("role", F.lit("context"))
    )
    test = labelled.filter(F.col("split") == "test").withColumn("role", F.lit("test"))
    return context.drop("split").unionByName(test.drop("split"))


def series_range(df, keys=KEYS, ts="ts") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def _walk_parts(horizon_hours: int, step_hours: int):
    """The four closed ranges of the walk-forward split as an array of structs."""
    first, last = F.col("first_ts"), F.col("last_ts")
    horizon, step = hours_interval(horizon_hours), hours_interval(step_hours)
    val_pred_start = last - horizon + step
    train_pred_start = val_pred_start - horizon
    train_pred_end = val_pred_start - step
    # encoding is as long as the history before the training prediction block
    train_enc_end = train_pred_start - step
    val_enc_start = first + horizon
    ranges = [
        ("train", "encode", first, train_enc_end),
        ("train", "predict", train_pred_start, train_pred_end),
        ("val", "encode", val_enc_start, train_enc_end + horizon),
        ("val", "predict", val_pred_start, last),
    ]
    return F.array(
        *[
            F.struct(
                F.lit(split).alias("split"), F.lit(part).alias("part"),
                low.alias("start_ts"), high.alias("end_ts"),
            )
            for split, part, low, high in ranges
        ]
    )


def walk_forward(df, horizon_hours: int, step_hours=1, keys=KEYS, ts="ts") -> DataFrame:
    """(keys, split, part, start_ts, end_ts): closed encode and predict ranges of each series."""
    return series_range(df, keys, ts).select(*keys, F.inline(_walk_parts(horizon_hours, step_hours)))


def walk_forward_rows(df, horizon_hours: int, step_hours=1, keys=KEYS, ts="ts") -> DataFrame:
    """Rows labelled with every (split, part) whose range holds them; encode ranges overlap."""
    ranged = attach_totals(df, keys, ts, mins={"first_ts": F.col(ts)}, maxs={"last_ts": F.col(ts)})
    hit = F.filter(
        _walk_parts(horizon_hours, step_hours),
        lambda p: (p["start_ts"] <= F.col(ts)) & (F.col(ts) <= p["end_ts"]),
    )
    return ranged.select(*df.columns, F.inline(hit)).drop("start_ts", "end_ts")

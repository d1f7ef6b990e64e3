"""Calendar and holiday features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourline.functions.dates import calendar_columns, holiday_name, holidays_of_year


def calendar_features(df, ts="ts", only: list[str] | None = None) -> DataFrame:
    columns = calendar_columns(F.col(ts))
    return df.withColumns({n: c for n, c in columns.items() if only is None or n in only})


def holidays_in(years: DataFrame) -> DataFrame:
    """(ds, holiday) for a DataFrame with an integer ``year`` column.

    A New Year's Day on Saturday is observed on 31 December of the year before, so the following
    year is generated too and cut back.
    """
    spans = years.select("year", F.explode(F.array(F.col("year"), F.col("year") + 1)).alias("y"))
    days = spans.select("year", F.inline(holidays_of_year("y")))
    return days.filter(F.year("ds") == F.col("year")).select("ds", "holiday")


def holiday_table(spark: SparkSession, from_year: int, to_year: int) -> DataFrame:
    years = spark.range(from_year, to_year + 1, numPartitions=1)
    return holidays_in(years.select(F.col("id").cast("int").alias("year")))


def holiday_flags(df, holidays: DataFrame | None = None, ts="ts") -> DataFrame:
    """Adds ``holiday_flag`` and ``off_flag`` = weekend or holiday.

    By default the federal rules are read off each row's own date. Another calendar is a frame of dates
    (``ds``), which Spark joins by its size.
    """
    if holidays is None:
        flagged = df.withColumn("_ds", F.to_date(ts)).withColumn("_h", holiday_name("_ds").isNotNull().cast("int"))
    else:
        days = holidays.select(F.col("ds").alias("_ds")).distinct().withColumn("_h", F.lit(1))
        flagged = df.withColumn("_ds", F.to_date(ts)).join(days, "_ds", "left")
    holiday = F.coalesce(F.col("_h"), F.lit(0))
    weekend = (F.weekday(F.col(ts)) > 4).cast("int")
    return flagged.withColumns({"holiday_flag": holiday, "off_flag": F.greatest(weekend, holiday)}).drop("_h", "_ds")

"""Parsing of dirty text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hourline.functions.dates import hours_interval


def parse_ts(text: Column, fmt: str = "yyyy-MM-dd HH:mm") -> Column:
    """Text to zone-free timestamp; NULL when the text does not match.

    The tolerant parser only decides whether the text matches: its own result passes through the
    session time zone, which moves wall clocks that a clock change skips.
    """
    matches = F.try_to_timestamp(text, F.lit(fmt)).isNotNull()
    return F.when(matches, F.to_timestamp_ntz(text, F.lit(fmt)))


def date_hour_ts(date: Column, hour: Column, date_fmt: str = "MM/dd/yyyy") -> Column:
    """Compose a timestamp from a date string and an hour number.

    The hour is added as an interval, so 24 rolls over to the next day; the format letters
    ``HH`` and ``kk`` reject 24 or map it to the same day.
    """
    day = F.try_to_date(date, date_fmt).cast("timestamp_ntz")
    return day + hours_interval(hour)


def fix_hour24(stamp: Column, date_fmt: str = "MM/dd/yyyy") -> Column:
    """``12/31/2016 24:00`` -> 2017-01-01 00:00; other hours and minutes as written.

    NULL unless the hour is 0 to 24, the minute 0 to 59, and 0 in hour 24.
    """

    def once(value: Column, use) -> Column:
        """``use`` of a value that is computed once, however often it is named."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def fields(parts: Column) -> Column:
        clock = F.split(F.get(parts, F.lit(1)), ":")
        written = F.get(clock, F.lit(1))
        minute = F.when(written.isNull(), F.lit(0)).otherwise(written.try_cast("int"))
        return F.struct(F.get(parts, F.lit(0)).alias("day"), F.get(clock, F.lit(0)).try_cast("int").alias("hour"), minute.alias("minute"))

    def stamped(f: Column) -> Column:
        valid = f["hour"].between(0, 24) & f["minute"].between(0, 59) & ((f["hour"] < 24) | (f["minute"] == 0))
        return F.when(valid, date_hour_ts(f["day"], f["hour"], date_fmt) + F.make_dt_interval(F.lit(0), F.lit(0), f["minute"]))

    return once(once(F.split(F.trim(stamp), " +"), fields), stamped)


def fix_thousands(text: Column) -> Column:
    """``1,234.5`` -> 1234.5; NULL when what is left is not a number."""
    return F.replace(text, F.lit(",")).try_cast("double")


def strict_int(text: Column) -> Column:
    """Whole text must be one integer (blanks around it allowed), else NULL."""
    return F.trim(text).try_cast("int")


def segment_hour(label: Column) -> Column:
    """``seg_4`` .. ``seg_99`` -> hour 0 .. 23."""
    number = F.element_at(F.split(label, "_"), 2).cast("int")
    return F.floor(number / 4).cast("int") - 1

"""Calendar expressions on zone-free timestamps.

Everything goes through DATE, ``hour`` and day-time intervals. ``date_trunc`` is avoided: on a
zone-free timestamp it detours through the session time zone and returns a zoned type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_interval(n) -> Column:
    """A whole-day interval; ``n`` is an int or an integer column."""
    return F.make_dt_interval(F.lit(n) if isinstance(n, int) else n)


def hours_interval(n) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n) if isinstance(n, int) else n)


def day_start(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz")


def hour_start(ts: Column) -> Column:
    """Truncate to the hour without leaving the zone-free type."""
    return day_start(ts) + hours_interval(F.hour(ts))


def epoch_day(ts: Column) -> Column:
    return F.unix_date(F.to_date(ts))


def epoch_second(ts: Column) -> Column:
    """Seconds since 1970-01-01 of the wall clock, independent of the session time zone."""
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return epoch_day(ts).cast("bigint") * 86400 + clock


def calendar_columns(ts: Column) -> dict[str, Column]:
    """Integer calendar features by name; Monday is day 0 and weeks follow ISO."""
    return {
        "hour_num": F.hour(ts),
        "day_num": F.weekday(ts),
        "wknd_flag": (F.weekday(ts) > 4).cast("int"),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "day_year": F.dayofyear(ts),
        "week_year": F.weekofyear(ts),
        "year": F.year(ts),
    }


# The ten United States federal holidays of 2010-2017.
# (name, month, day) on a fixed date; (name, month, weekday, n) on the n-th weekday, n = -1 the last.
FIXED_HOLIDAYS = [
    ("New Year's Day", 1, 1),
    ("Independence Day", 7, 4),
    ("Veterans Day", 11, 11),
    ("Christmas Day", 12, 25),
]
WEEKDAY_HOLIDAYS = [
    ("Martin Luther King Jr. Day", 1, "Mon", 3),
    ("Washington's Birthday", 2, "Mon", 3),
    ("Memorial Day", 5, "Mon", -1),
    ("Labor Day", 9, "Mon", 1),
    ("Columbus Day", 10, "Mon", 2),
    ("Thanksgiving", 11, "Thu", 4),
]
HOLIDAY_NAMES = [h[0] for h in FIXED_HOLIDAYS + WEEKDAY_HOLIDAYS]


def _nth_weekday(year: str, month: int, weekday: str, n: int) -> str:
    first = f"make_date({year}, {month}, 1)"
    if n < 0:
        return f"next_day(date_sub(last_day({first}), 7), '{weekday}')"
    return f"date_add(next_day(date_sub({first}, 1), '{weekday}'), {7 * (n - 1)})"


def holidays_of_year(year: str) -> Column:
    """ARRAY<STRUCT<ds, holiday>> for a year column: each holiday, plus its weekday stand-in when it
    falls on a weekend.

    Written as SQL text: building it from some hundred column objects takes longer than running it.
    """
    entries = []
    for name, month, day in FIXED_HOLIDAYS:
        date = f"make_date({year}, {month}, {day})"
        shift = f"CASE weekday({date}) WHEN 5 THEN -1 WHEN 6 THEN 1 END"
        entries.append((date, name))
        entries.append((f"date_add({date}, {shift})", f"{name} (Observed)"))
    entries += [(_nth_weekday(year, *rule), name) for name, *rule in WEEKDAY_HOLIDAYS]
    structs = ", ".join(f'named_struct(\'ds\', {date}, \'holiday\', "{name}")' for date, name in entries)
    return F.expr(f"filter(array({structs}), h -> h.ds IS NOT NULL)")


def holiday_name(day: str) -> Column:
    """The holiday that a DATE expression falls on, stand-ins included, or NULL; for any year.

    A stand-in is the Friday before a fixed date on Saturday or the Monday after one on Sunday. The
    rules read the date itself, so there is no table of years to join.
    """
    number = {"Mon": 0, "Thu": 3}
    tests = []
    for name, month, dom in FIXED_HOLIDAYS:
        for shift, weekday in ((0, None), (1, 4), (-1, 0)):
            date = f"date_add({day}, {shift})" if shift else day
            test = f"month({date}) = {month} AND day({date}) = {dom}"
            tests.append((test if weekday is None else f"{test} AND weekday({day}) = {weekday}", name))
    for name, month, weekday, n in WEEKDAY_HOLIDAYS:
        nth = f"month(date_add({day}, 7)) <> {month}" if n < 0 else f"day({day}) BETWEEN {7 * n - 6} AND {7 * n}"
        tests.append((f"month({day}) = {month} AND weekday({day}) = {number[weekday]} AND {nth}", name))
    cases = " ".join(f'WHEN {test} THEN "{name}"' for test, name in tests)
    return F.expr(f"CASE {cases} END")

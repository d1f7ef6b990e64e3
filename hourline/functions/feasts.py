"""Public holidays of several countries as rules on the year, in column arithmetic.

A rule is a fixed date, the n-th weekday of a month, or a distance from Easter Sunday, which follows from the
year by the Gregorian computus. A fixed date may have substitute days, by the weekday it falls on; both the date and its
substitute are holidays. Rules hold for all years alike: days that were introduced or moved in some year aren't told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Nationwide holidays. ("fixed", name, month, day, {ISO weekday: days to the substitute}),
# ("nth", name, month, ISO weekday, n) with n = -1 for the last, ("easter", name, days after Easter Sunday).
RULES: dict[str, list[tuple]] = {
    "DE": [
        ("fixed", "Neujahr", 1, 1, {}), ("easter", "Karfreitag", -2), ("easter", "Ostermontag", 1), ("fixed", "Tag der Arbeit", 5, 1, {}), ("easter", "Christi Himmelfahrt", 39),
        ("easter", "Pfingstmontag", 50), ("fixed", "Tag der Deutschen Einheit", 10, 3, {}), ("fixed", "Erster Weihnachtstag", 12, 25, {}), ("fixed", "Zweiter Weihnachtstag", 12, 26, {}),
    ],
    "FR": [
        ("fixed", "Jour de l'an", 1, 1, {}), ("easter", "Lundi de Pâques", 1), ("fixed", "Fête du Travail", 5, 1, {}), ("fixed", "Victoire 1945", 5, 8, {}), ("easter", "Ascension", 39),
        ("easter", "Lundi de Pentecôte", 50), ("fixed", "Fête nationale", 7, 14, {}), ("fixed", "Assomption", 8, 15, {}), ("fixed", "Toussaint", 11, 1, {}), ("fixed", "Armistice", 11, 11, {}),
        ("fixed", "Noël", 12, 25, {}),
    ],
    "GB": [
        ("fixed", "New Year's Day", 1, 1, {6: 2, 7: 1}), ("easter", "Good Friday", -2), ("easter", "Easter Monday", 1), ("nth", "Early May Bank Holiday", 5, 1, 1),
        ("nth", "Spring Bank Holiday", 5, 1, -1), ("nth", "Summer Bank Holiday", 8, 1, -1), ("fixed", "Christmas Day", 12, 25, {6: 2, 7: 2}), ("fixed", "Boxing Day", 12, 26, {6: 2, 7: 2}),
    ],
}


def easter(year: Column) -> Column:
    """Easter Sunday of a year, as a DATE."""
    floor = lambda x, n: F.floor(x / n).cast("int")
    golden, century, rest = year % 19, floor(year, 100), year % 100
    skipped = floor(century - floor(century + 8, 25) + 1, 3)
    moon = (19 * golden + century - floor(century, 4) - skipped + 15) % 30
    weekday = (32 + 2 * (century % 4) + 2 * floor(rest, 4) - moon - rest % 4) % 7
    late = floor(golden + 11 * moon + 22 * weekday, 451)
    number = moon + weekday - 7 * late + 114
    return F.make_date(year, floor(number, 31), number % 31 + 1)


def _nth(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th weekday (1 = Monday) of a month, or the last one."""
    if n < 0:
        last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
        return F.date_sub(last, F.pmod(F.weekday(last) + 1 - weekday, F.lit(7)))
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first) - 1, F.lit(7)) + 7 * (n - 1))


def days_of_year(year: Column, country: str) -> Column:
    """ARRAY<STRUCT<ds, holiday, substitute>> of a year."""
    sunday, made = easter(year), []

    def day(ds: Column, name: str, substitute: bool = False) -> Column:
        return F.struct(ds.alias("ds"), F.lit(name).alias("holiday"), F.lit(substitute).alias("substitute"))

    for kind, name, *rule in RULES[country]:
        if kind == "easter":
            made.append(day(F.date_add(sunday, F.lit(rule[0])), name))
        elif kind == "nth":
            made.append(day(_nth(year, *rule), name))
        else:
            ds = F.make_date(year, F.lit(rule[0]), F.lit(rule[1]))
            made.append(day(ds, name))
            for weekday, shift in rule[2].items():
                made.append(F.when(F.weekday(ds) + 1 == weekday, day(F.date_add(ds, shift), name, True)))
    return F.array_compact(F.array(*made))


def country_days(years: DataFrame, country: str, year: str = "year") -> DataFrame:
    """(ds, holiday, substitute) of the given years."""
    return years.select(F.inline(days_of_year(F.col(year), country)))


def with_country_flag(df: DataFrame, country: str, name: str = "holiday_flag", ts: str = "ts") -> DataFrame:
    """Adds whether the row's own date is a holiday; the days of a year are worked out once for each row, no table is joined."""
    days = F.transform(days_of_year(F.year(ts), country), lambda d: d["ds"])
    return df.withColumn(name, F.array_contains(days, F.to_date(ts)).cast("int"))

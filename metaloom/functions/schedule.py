"""Cron schedules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metaloom.functions.classify import first_match, lookup

# Schedule presets and frequency scores
PRESETS = {
    "@hourly": "0 * * * *", "@daily": "0 0 * * *", "@weekly": "0 0 * * 0", "@monthly": "0 0 1 * *", "@yearly": "0 0 1 1 *",
}
UNSCHEDULED = ["@once", "None"]
FREQUENCY_SCORES = [
    (("@hourly", "0 * * * *"), 10.0), (("@daily", "0 0 * * *"), 8.0), (("@weekly", "0 0 * * 0"), 4.0), (("@monthly", "0 0 1 * *"), 2.0),
]


def cron_of(schedule: Column) -> Column:
    """The cron expression of a schedule; null for one-time and unscheduled."""
    return F.when(~schedule.isin(UNSCHEDULED) & (schedule != ""), F.coalesce(lookup(PRESETS, schedule), schedule))


def _fields(cron: Column) -> Column:
    return F.split(F.trim(cron), r"\s+")


def _field(cron: Column, i: int) -> Column:
    return F.when(F.size(_fields(cron)) == 5, F.get(_fields(cron), F.lit(i)))


def runs_per_day(cron: Column) -> Column:
    """Heuristic daily count: every minute 1440, every hour 24, else listed minutes times listed hours.

    A step such as ``*/6`` counts as one entry.
    """
    minute, hour = _field(cron, 0), _field(cron, 1)
    listed = (F.size(F.split(minute, ",")) * F.size(F.split(hour, ","))).cast("double")
    return F.when(cron.isNotNull(), first_match([
        (minute.isNull(), F.lit(1.0)),
        ((minute == "*") & (hour == "*"), F.lit(1440.0)),
        (hour == "*", F.lit(24.0)),
        (minute != "*", listed),
    ], 1.0))


def _values(field: Column, limit: int) -> Column:
    """The numbers a cron field stands for, below ``limit``."""
    step = F.try_element_at(F.split(field, "/"), F.lit(2)).try_cast("int")
    digits = F.transform(F.filter(F.split(field, ","), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int"))
    return first_match([
        (field == "*", F.sequence(F.lit(0), F.lit(limit - 1))),
        (field.contains(",") | field.rlike("^[0-9]+$"), digits),
        (field.contains("/") & (step > 0), F.sequence(F.lit(0), F.lit(limit - 1), F.when(step > 0, step).otherwise(1))),
    ], F.array().cast("array<int>"))


def hours_of(cron: Column) -> Column:
    """Hours of the day a cron expression runs in."""
    return F.coalesce(_values(_field(cron, 1), 24), F.array().cast("array<int>"))


def minutes_of(cron: Column) -> Column:
    return F.coalesce(_values(_field(cron, 0), 60), F.array().cast("array<int>"))


def frequency_score(schedule: Column) -> Column:
    """Weight of a schedule's frequency in a risk score; substring tests in order."""
    low = F.lower(schedule)
    stars = F.length(low) - F.length(F.replace(low, F.lit("*"), F.lit("")))
    cases = [(low.contains(a) | low.contains(b), F.lit(score)) for (a, b), score in FREQUENCY_SCORES]
    return first_match(cases, F.least(F.lit(10.0), stars * 2.0))


def period_of(hour: Column) -> Column:
    """Time of day of an hour."""
    return first_match([((hour >= 6) & (hour < 12), "morning"), ((hour >= 12) & (hour < 18), "afternoon"), ((hour >= 18) & (hour < 22), "evening")], "night")


MONTH_NAMES = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
DAY_NAMES = ["SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT"]
#: a date of the calendar returns within so many months at most (29 February around a year without one)
LONGEST_GAP_MONTHS = 8 * 12 + 1


def _fitting(field: Column, low: int, high: int, names: list[str] | None = None, first_name: int = 0) -> Column:
    """Sorted values of a cron field: ``*``, ``a``, ``a-b``, each with ``/step``, names, lists of these; wrong parts fit nothing."""
    text = F.upper(field)
    for i, name in enumerate(names or []):
        text = F.regexp_replace(text, name, str(i + first_name))

    def values(part: Column) -> Column:
        split, base = F.split(part, "/"), F.substring_index(part, "/", 1)
        ends = F.split(base, "-")
        every, stepped = base.isin("*", "?"), F.size(split) == 2
        step = F.when(stepped, F.try_element_at(split, F.lit(2)).try_cast("int")).otherwise(1)
        first = F.when(every, low).otherwise(F.get(ends, F.lit(0)).try_cast("int"))
        last = F.when(every | (stepped & (F.size(ends) == 1)), high).when(F.size(ends) == 2, F.get(ends, F.lit(1)).try_cast("int")).otherwise(first)
        good = (F.size(split) <= 2) & (F.size(ends) <= 2) & (step > 0) & (first >= low) & (first <= last) & (last <= high)
        return F.when(good, F.sequence(first, last, step)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(text, ","), values))))


def next_run(cron: Column, now: str) -> Column:
    """First run after ``now``; null when no date ever fits.

    Months that fit are taken first, then their days, then the minutes of the
    day, so no row is multiplied.  Two restricted day fields mean either.
    """
    at = F.lit(now).cast("timestamp_ntz")
    today, minute_now = F.to_date(at), F.hour(at) * 60 + F.minute(at)
    minutes, hours = _fitting(_field(cron, 0), 0, 59), _fitting(_field(cron, 1), 0, 23)
    days, months = _fitting(_field(cron, 2), 1, 31), _fitting(_field(cron, 3), 1, 12, MONTH_NAMES, 1)
    weekdays = F.transform(_fitting(_field(cron, 4), 0, 7, DAY_NAMES), lambda d: F.pmod(d, F.lit(7)))
    every_day, every_weekday = _field(cron, 2).isin("*", "?"), _field(cron, 4).isin("*", "?")

    def fits(day: Column) -> Column:
        by_day, by_week = F.array_contains(days, F.dayofmonth(day)), F.array_contains(weekdays, F.dayofweek(day) - 1)
        return F.when(~every_day & ~every_weekday, by_day | by_week).otherwise(by_day & by_week)

    def days_of(start: Column) -> Column:
        month = F.sequence(F.greatest(start, today), F.last_day(start))
        return F.filter(month, fits)

    starts = F.transform(F.sequence(F.lit(0), F.lit(LONGEST_GAP_MONTHS)), lambda i: F.add_months(F.trunc(today, "month"), i))
    fitting = F.filter(starts, lambda d: F.array_contains(months, F.month(d)))
    # at most one list of days is kept: that of the first month with a fitting day after today
    later = F.aggregate(fitting, F.lit(None).cast("date"), lambda found, m: F.coalesce(found, F.get(F.filter(days_of(m), lambda d: d > today), F.lit(0))))
    times = F.flatten(F.transform(hours, lambda h: F.transform(minutes, lambda m: h * 60 + m)))
    left_today = F.get(F.filter(times, lambda t: t > minute_now), F.lit(0))
    runs_today = F.array_contains(months, F.month(today)) & fits(today) & left_today.isNotNull()
    day = F.when(runs_today, today).otherwise(later)
    minute = F.when(runs_today, left_today).otherwise(F.get(times, F.lit(0)))
    return F.when(F.size(times) > 0, day.cast("timestamp_ntz") + F.make_dt_interval(mins=minute))

"""Next run times of schedules, in columns: intervals by name or seconds, and cron expressions of five or six fields.

A field is the array of its values. The next time on the day that has begun is the least of three candidates: a later
second of this minute, a later minute of this hour, a later hour; if there is none, or the day is not one of the
schedule's, it is the first time of the next day that is. All in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: Days that are searched for a match; leap days come at most eight years apart.
HORIZON_DAYS = 3660


def cron_values(field: Column, low: int, high: int, sunday: bool = False) -> Column:
    """The values of a field (``*``, ``*/n``, ``a``, ``a-b``, ``a-b/n``, lists of these), sorted; null if it is none.
    ``sunday``: 7 is 0."""
    top = 7 if sunday else high

    def one(part: Column) -> Column:
        pieces = F.split(part, "/")
        span, step = pieces[0], F.coalesce(F.get(pieces, F.lit(1)).try_cast("int"), F.lit(1))
        ends = F.split(span, "-")
        first = F.when(span == "*", F.lit(low)).otherwise(ends[0].try_cast("int"))
        last = F.when(span == "*", F.lit(high)).when(F.size(ends) == 2, F.get(ends, F.lit(1)).try_cast("int")).otherwise(first)
        good = part.rlike(r"^(?:\*|[0-9]{1,2}(?:-[0-9]{1,2})?)(?:/[0-9]{1,3})?$") & (first >= low) & (last <= top) & (first <= last) & (step >= 1)
        return F.when(F.coalesce(good, F.lit(False)), F.sequence(first, F.greatest(first, last), F.greatest(step, F.lit(1))))

    sets = F.transform(F.split(field, ","), lambda x: one(F.trim(x)))
    values = F.flatten(sets)  # null as soon as one part is
    folded = F.transform(values, lambda v: F.when(v == 7, F.lit(0)).otherwise(v)) if sunday else values
    return F.array_sort(F.array_distinct(folded))


def _from(values: Column, least: Column) -> Column:
    """The first of sorted values from ``least`` on, or null."""
    return F.array_min(F.filter(values, lambda v: v >= least))


def next_cron_time(expression: Column, after: Column) -> Column:
    """The first time that matches after ``after``; null for an expression that is none or never matches. Days are those
    of the month or those of the week if both are given. Without a field of seconds, whole minutes."""
    parts = F.filter(F.split(strip(F.coalesce(expression, F.lit(""))), r"\s+"), lambda x: x != "")
    exact = F.size(parts) == 6
    field = lambda k: F.get(parts, F.when(exact, F.lit(k + 1)).otherwise(F.lit(k)))
    seconds = F.when(exact, cron_values(parts[0], 0, 59)).otherwise(F.array(F.lit(0)))
    start = F.date_trunc("second", after)
    start = F.when(exact, start + F.expr("INTERVAL 1 SECOND")).otherwise(F.date_trunc("minute", after) + F.expr("INTERVAL 1 MINUTE"))
    given = F.struct(
        cron_values(field(0), 0, 59).alias("minutes"),
        cron_values(field(1), 0, 23).alias("hours"),
        cron_values(field(2), 1, 31).alias("days"),
        cron_values(field(3), 1, 12).alias("months"),
        cron_values(field(4), 0, 6, sunday=True).alias("weekdays"),
        seconds.alias("seconds"),
        (field(2) == "*").alias("any_day"),
        (field(4) == "*").alias("any_weekday"),
        start.alias("start"),
    )

    def first(g: Column) -> Column:
        def fits(day: Column) -> Column:
            by_month = F.array_contains(g["days"], F.dayofmonth(day))
            by_week = F.array_contains(g["weekdays"], F.dayofweek(day) - 1)
            right = F.when(g["any_day"] & g["any_weekday"], F.lit(True)).when(g["any_day"], by_week).when(g["any_weekday"], by_month).otherwise(by_month | by_week)
            return F.array_contains(g["months"], F.month(day)) & right

        h, m, s = F.hour(g["start"]), F.minute(g["start"]), F.second(g["start"])
        least = lambda c: F.array_min(g[c])
        clock = lambda hour, minute, second: hour * 3600 + minute * 60 + second
        in_hour, in_minute = F.array_contains(g["hours"], h), F.array_contains(g["minutes"], m)
        today = F.coalesce(
            F.when(in_hour & in_minute, clock(h, m, _from(g["seconds"], s))),
            F.when(in_hour, clock(h, _from(g["minutes"], m + 1), least("seconds"))),
            clock(_from(g["hours"], h + 1), least("minutes"), least("seconds")),
        )
        day = F.to_date(g["start"])
        # Months of the schedule, and of their days the first that fits: two months ahead, a year, ten years, as far as needed.
        months = F.filter(F.sequence(F.trunc(day, "month"), F.date_add(day, HORIZON_DAYS), F.expr("INTERVAL 1 MONTH")), lambda x: F.array_contains(g["months"], F.month(x)))
        in_month = lambda x: F.array_min(F.filter(F.sequence(F.greatest(x, F.date_add(day, 1)), F.greatest(F.last_day(x), F.date_add(day, 1))), lambda d: fits(d) & (d > day)))
        ahead = lambda n: F.array_min(F.transform(F.slice(months, 1, n), in_month))
        later = F.coalesce(ahead(2), ahead(13), ahead(125))
        at = lambda d, t: F.timestamp_add("SECOND", t.cast("int"), d.cast("timestamp"))
        return F.when(fits(day) & today.isNotNull(), at(day, today)).otherwise(at(later, clock(least("hours"), least("minutes"), least("seconds"))))

    return F.when(F.size(parts).isin(5, 6), F.transform(F.array(given), first)[0])


def next_run(interval: Column, after: Column) -> Column:
    """hourly, daily, weekly, a number of seconds (``90s``, at least one) after ``after``, else a cron expression. Null and
    blank: daily."""
    name = F.lower(strip(F.coalesce(interval, F.lit(""))))
    name = F.when(name == "", F.lit("daily")).otherwise(name)
    seconds = F.greatest(F.lit(1), F.regexp_extract(name, r"^([0-9]{1,9})s$", 1).try_cast("int"))
    add = lambda unit, n: F.timestamp_add(unit, n, after)
    named = F.when(name == "hourly", add("HOUR", F.lit(1))).when(name == "daily", add("DAY", F.lit(1))).when(name == "weekly", add("WEEK", F.lit(1)))
    return named.when(name.rlike("^[0-9]{1,9}s$"), add("SECOND", F.coalesce(seconds, F.lit(1)))).otherwise(next_cron_time(name, after))


def due(schedules: DataFrame, as_of: Column, interval_col: str = "interval", next_col: str = "next_run_at") -> DataFrame:
    """Schedules whose time has come, with ``following``: the run after ``as_of``. Runs that were missed are not made up for;
    a schedule of fixed length keeps its own rhythm."""
    name = F.lower(F.col(interval_col))
    length = F.when(name == "hourly", 3600).when(name == "daily", 86_400).when(name == "weekly", 604_800).when(name.rlike("^[0-9]{1,9}s$"), F.greatest(F.lit(1), F.regexp_extract(name, "^([0-9]+)", 1).try_cast("int")))
    behind = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(next_col)
    fixed = F.timestamp_add("SECOND", (F.floor(behind / length) * length + length).cast("int"), F.col(next_col))
    # A cron expression's next time does not depend on where it is counted from.
    return schedules.where(F.col(next_col) <= as_of).withColumn("following", F.when(length.isNotNull(), fixed).otherwise(next_cron_time(F.col(interval_col), as_of)))

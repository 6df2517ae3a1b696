"""Calendar: recurring events, schedules, series edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.scalars import _c, parse_clock_time


def next_occurrence(day, kind, interval) -> Column:
    """The date one step later. A month step keeps the day number and overflows into the following month."""
    d, n = _c(day), F.coalesce(_c(interval), F.lit(1))
    month = F.date_add(F.add_months(F.trunc(d, "month"), n), F.dayofmonth(d) - 1)
    return F.when(_c(kind) == "daily", F.date_add(d, n)).when(_c(kind) == "weekly", F.date_add(d, 7 * n)).when(_c(kind) == "monthly", month)


def expand_recurrence(events: DataFrame) -> DataFrame:
    """One row per occurrence, ``occurs_on``, from event_date to recur_end_date inclusive; one row without recurrence or end."""
    n = F.coalesce("recurrence_interval", F.lit(1))
    days = F.when(F.col("recurrence") == "daily", n).otherwise(7 * n)
    steps = F.floor(F.datediff("recur_end_date", "event_date") / days).cast("int")
    regular = F.transform(F.sequence(F.lit(0), steps), lambda i: F.date_add("event_date", (i * days).cast("int")))
    months = F.floor(F.months_between("recur_end_date", "event_date") / n).cast("int") + 1
    walked = F.aggregate(
        F.sequence(F.lit(1), months),
        F.array("event_date"),
        lambda acc, i: F.array_append(acc, next_occurrence(F.element_at(acc, -1), F.lit("monthly"), n)),
    )
    dates = (
        F.when(F.col("recurrence").isNull() | F.col("recur_end_date").isNull(), F.array("event_date"))
        .when(F.col("recur_end_date") < F.col("event_date"), F.array().cast("array<date>"))
        .when(F.col("recurrence") == "monthly", F.filter(walked, lambda d: d <= F.col("recur_end_date")))
        .otherwise(regular)
    )
    return events.withColumn("occurs_on", F.explode(dates))


def only_future(occurrences: DataFrame, now: Column) -> DataFrame:
    """Occurrences on a later date, or today at a time that has not passed."""
    minutes = F.hour(now) * 60 + F.minute(now)
    today = F.to_date(now)
    return occurrences.filter((F.col("occurs_on") > today) | ((F.col("occurs_on") == today) & (parse_clock_time("time") >= minutes)))


def day_schedule(occurrences: DataFrame, day: Column) -> DataFrame:
    """Each user's events of a date with their place by time."""
    order = Window.partitionBy("user_id").orderBy(parse_clock_time("time"), "event_id")
    return occurrences.filter(F.col("occurs_on") == day).withColumn("place", F.row_number().over(order))


def upcoming_events(occurrences: DataFrame, now: Column, k: int = 3) -> DataFrame:
    """The next k occurrences of each user by date, then time."""
    order = Window.partitionBy("user_id").orderBy("occurs_on", parse_clock_time("time"), "event_id")
    return only_future(occurrences, now).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def marked_dates(occurrences: DataFrame, group_id: int | None = None) -> DataFrame:
    """Events and reminders per user and date; of one group if given."""
    rows = occurrences if group_id is None else occurrences.filter(F.col("group_id") == group_id)
    return rows.groupBy("user_id", "occurs_on").agg(F.count(F.lit(1)).alias("events"), F.count_if("notify").alias("reminders"))


def split_series(events: DataFrame, edits: DataFrame) -> DataFrame:
    """Deltas (event_id, action, part, event_date, recur_end_date) of edits (event_id, on_date, scope, title).

    Scope ``this`` takes one date out of its series and inserts a single event; ``following``
    ends the series before the date and inserts the rest as a new series. A series that starts
    on the edited date advances to its next date, or goes when nothing is left of it.
    """
    e = events.join(edits.select("event_id", "on_date", "scope"), "event_id")
    recurs = F.col("recurrence").isNotNull() & F.col("recur_end_date").isNotNull()
    following_date = next_occurrence("on_date", "recurrence", "recurrence_interval")
    has_tail = recurs & (following_date <= F.col("recur_end_date"))
    at_start = F.col("event_date") == F.col("on_date")
    none = F.lit(None).cast("date")

    def row(action, part, start, end):
        return F.struct(F.lit(action).alias("action"), F.lit(part).alias("part"), start.alias("event_date"), end.alias("recur_end_date"))

    start, end, on = F.col("event_date"), F.col("recur_end_date"), F.col("on_date")
    this = (
        F.when(~recurs, F.array(row("update", "single", start, none)))
        .when(at_start & has_tail, F.array(row("update", "series", following_date, end), row("insert", "single", on, none)))
        .when(at_start, F.array(row("delete", "series", start, end), row("insert", "single", on, none)))
        .when(
            has_tail,
            F.array(
                row("update", "series", start, F.date_sub(on, 1)),
                row("insert", "tail", following_date, end),
                row("insert", "single", on, none),
            ),
        )
        .otherwise(F.array(row("update", "series", start, F.date_sub(on, 1)), row("insert", "single", on, none)))
    )
    following = (
        F.when(~recurs, F.array(row("update", "single", start, none)))
        .when(at_start, F.array(row("update", "series", start, end)))
        .otherwise(F.array(row("update", "series", start, F.date_sub(on, 1)), row("insert", "tail", on, end)))
    )
    return e.select("event_id", F.explode(F.when(F.col("scope") == "this", this).otherwise(following)).alias("d")).select("event_id", "d.*")

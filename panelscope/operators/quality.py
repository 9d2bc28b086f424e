"""Checks of the raw input: totals, duplicates, period and daily profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope import config as C
from panelscope.functions.exprs import count_where, is_non_us_host


def activity(raw: DataFrame) -> DataFrame:
    """One row per (day, hour, user): rows, those on non-US domains, those with nulls, first and last second, and the named sites visited.

    The one pass over the raw input that every report on its rows and users reads; all its columns can be added up further.
    """
    any_null = F.lit(False)
    for c in ("user_id", "session_id", "created_time", "host", "url"):
        any_null = any_null | F.col(c).isNull()
    return raw.groupBy(F.to_date("created_time").alias("day"), F.hour("created_time").cast("long").alias("hour"), "user_id").agg(
        F.count("*").alias("n"), count_where(is_non_us_host("host")).alias("non_us"), count_where(any_null).alias("nulls"),
        F.min("created_time").alias("low"), F.max("created_time").alias("high"), F.coalesce(F.bit_or(site_bit("host")), F.lit(0).cast("long")).alias("sites"))


def site_bit(host: str) -> Column:
    """The bit of a coverage site; null for other hosts."""
    if len(C.COVERAGE_SITES) > 63:
        raise ValueError("at most 63 coverage sites fit a number")
    out = F
    for i, (site, _) in enumerate(C.COVERAGE_SITES):
        out = out.when(F.col(host) == site, F.lit(1 << i).cast("long"))
    return out


def dq_profile(raw: DataFrame, activity: DataFrame, panel_users: DataFrame) -> DataFrame:
    """One row of input totals.

    Totals are added up from the stored activity. Each distinct count of ids or events is a group-by over only the columns it
    needs and a count of its groups: aggregates with different keys stay apart, while several distinct counts
    in one aggregate would multiply every input row.
    """

    def distinct(*cols: str):
        known = raw.where(F.col(cols[0]).isNotNull()) if len(cols) == 1 else raw
        return known.groupBy(*cols).agg(F.lit(1).alias("one")).agg(F.count("one")).scalar()

    per_day = activity.groupBy("day").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("nulls").alias("nulls"))
    totals = per_day.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.min("low").alias("first_event_utc"), F.max("high").alias("last_event_utc"),
        F.count("day").alias("days"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("rows_with_nulls"))
    return totals.select(
        "rows",
        distinct("event_id").alias("distinct_event_ids"),
        (F.col("rows") - distinct("user_id", "created_time", "url")).alias("duplicate_rows"),
        panel_users.agg(F.count("user_id")).scalar().alias("users"),
        distinct("session_id").alias("sessions"),
        "first_event_utc",
        "last_event_utc",
        "days",
        "rows_with_nulls",
    )


def dq_hourly(activity: DataFrame) -> DataFrame:
    """Rows and distinct users by hour of day (UTC).

    Grouping by (hour, user) first turns the distinct count into a plain count, and the
    second group-by only sees one partial row per hour and task.
    """
    per_user = activity.groupBy(F.col("hour").alias("utc_hour"), "user_id").agg(F.sum("n").alias("n"))
    return per_user.groupBy("utc_hour").agg(F.sum("n").alias("rows"), F.count("user_id").alias("users"))

"""Person-days: bounded groups for everything that looks a limited time back or ahead.

A person's events of one day are one group, and so are the few events before and after midnight that the day's rows look
at: those are in the neighbouring day's group once more, marked as not its own. Windows are keyed by (person, day); a
person with ninety days is ninety groups, and none grows with the length of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelscope import config as C
from panelscope.functions.exprs import event_second

DAY_S = 86_400
#: How far rows of a day look back into the day before, and ahead into the day after.
LOOK_BACK_S = max(C.CONTEXT_BEFORE_S, C.VISIT_GAP_S, C.HOP_CHAIN_S, C.SEARCH_BEFORE_S, C.COUPON_BEFORE_S, C.BURST_S)
LOOK_AHEAD_S = max(C.CONTEXT_AFTER_S, C.HOP_LANDING_S, C.BURST_S)

PERSON_DAY = ("user_id", "day")


def by_day(rows: DataFrame, sec: str = "sec") -> DataFrame:
    """Rows with their ``day`` (days since 1970), and once more, not ``own``, for a neighbouring day that looks at them."""
    at = F.col(sec)
    day = F.floor(at / DAY_S)
    days = F.array_compact(F.array(
        day, F.when(at - day * DAY_S <= LOOK_AHEAD_S, day - 1), F.when((day + 1) * DAY_S - at <= LOOK_BACK_S, day + 1)))
    return rows.withColumn("day", F.explode(days)).withColumn("own", F.col("day") == day)


def days_of(events: DataFrame) -> DataFrame:
    """Person-days as they are; events that are not dealt out by day yet, dealt out."""
    return events if "day" in events.columns else by_day(events.withColumn("sec", event_second("created_time")))


def lists_by_day(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per (person, day) with the list ``beside`` of its rows: ``sec``, ``own`` and ``columns``. For rows far rarer than events."""
    return by_day(rows).groupBy(*PERSON_DAY).agg(F.collect_list(F.struct("sec", "own", *columns)).alias("beside"))


def with_lists(person_days: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    """Events of person-days, the first one of each carrying the list ``beside``, all others an empty one.

    Events lie by (person, day) already, so only the lists are dealt out. A list meets its one event only: joined with every event
    of a day, it would be copied as often as the day has events, and rows would grow with the square of a busy day.
    """
    first = F.row_number().over(W.partitionBy(*PERSON_DAY).orderBy("sec")) == 1
    days = person_days if how == "left" else person_days.join(lists.select(*PERSON_DAY), list(PERSON_DAY), "left_semi")
    events, beside = days.withColumn("_first", first).alias("events"), lists.select(*PERSON_DAY, "beside").alias("lists")
    same = [F.col(f"events.{c}") == F.col(f"lists.{c}") for c in PERSON_DAY]
    nothing = F.array().cast(lists.schema["beside"].dataType)
    return events.join(beside, [*same, F.col("events._first")], "left").select(
        *[F.col(f"events.{c}") for c in person_days.columns], F.coalesce("lists.beside", nothing).alias("beside"))


def row_of(kind: str, **columns: Column) -> Column:
    """A struct of a fixed type ``kind`` (DDL of its fields); fields that are not given are null."""
    fields = [f.strip().split(": ", 1) for f in kind.split(";")]
    return F.struct(*[(columns[name] if name in columns else F.lit(None)).cast(of).alias(name) for name, of in fields])

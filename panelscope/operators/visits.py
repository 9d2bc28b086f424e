"""Visits to the brands' main sites, and where they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelscope import config as C
from panelscope.functions.days import days_of
from panelscope.functions.exprs import first_match, has_affiliate_marker, second_to_ts


def brand_visits(person_days: DataFrame) -> DataFrame:
    """Runs of one person's pageviews on a brand's site; a gap of more than 30 minutes starts a new visit.

    Pageviews collapse to one row per second, and visits are found within a day: a page starts one if none came
    in the 30 minutes before it, which may be in the day before. What a day has before its first start goes on from
    there. Those parts, not events, are then numbered and put together per person. Events without days are dealt out first.
    """
    keys = ["user_id", "day", "brand"]
    seconds = days_of(person_days).where("is_brand_page").groupBy(*keys, "sec", "own").agg(
        F.count("*").alias("pageviews"),
        F.min("url").alias("url"),
        F.bool_or(has_affiliate_marker("url")).alias("marked"),
    )
    w = W.partitionBy(*keys).orderBy("sec")
    gap = F.col("sec") - F.lag("sec").over(w)
    starts = F.when(F.col("own") & (gap.isNull() | (gap > C.VISIT_GAP_S)), 1).otherwise(0)
    parts = (
        seconds.withColumn("starts", starts)
        .withColumn("part", F.sum("starts").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).where("own")
        .groupBy(*keys, "part").agg(
            F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"), F.sum("pageviews").alias("pageviews"),
            F.min_by("url", "sec").alias("entry_url"), F.bool_or("marked").alias("marked"))
    )
    over_days = W.partitionBy("brand", "user_id").orderBy("first_sec").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        parts.withColumn("visit_no", F.sum(F.when(F.col("part") > 0, 1).otherwise(0)).over(over_days))
        .groupBy("brand", "user_id", "visit_no").agg(
            F.min("first_sec").alias("first_sec"), F.max("last_sec").alias("last_sec"), F.sum("pageviews").alias("pageviews"),
            F.min_by("entry_url", "first_sec").alias("entry_url"), F.bool_or("marked").alias("affiliate_anywhere"))
        .select(
            "brand", "user_id", "visit_no", second_to_ts("first_sec").alias("visit_start"), second_to_ts("last_sec").alias("visit_end"),
            "pageviews", "entry_url", has_affiliate_marker("entry_url").alias("affiliate_entry"), "affiliate_anywhere")
    )


def brand_visit_sources(visits: DataFrame) -> DataFrame:
    """Source of each visit from its entry URL, first match wins."""
    tagged = first_match(F.col("entry_url"), C.ENTRY_SOURCES, C.ENTRY_SOURCE_DEFAULT)
    return visits.withColumn(
        "entry_source", F.when(F.col("affiliate_entry"), C.ENTRY_SOURCE_AFFILIATE).otherwise(tagged))

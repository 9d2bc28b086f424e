"""Click flooding: few people with very many clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope import config as C
from panelscope.functions.days import DAY_S, PERSON_DAY
from panelscope.functions.exprs import count_where, event_second, round_half
from panelscope.operators.summary import pct1, pct2


def _per_person(us_clicks: DataFrame, *more: str | Column) -> DataFrame:
    strong, conv = F.col("strong_hijack_signal"), F.col("converted")
    return us_clicks.groupBy("brand", "user_id", *more).agg(
        F.count("*").alias("clicks"), count_where(conv).alias("orders"),
        count_where(strong).alias("strong"), count_where(strong & conv).alias("strong_orders"))


def click_flood_behaviour(us_clicks: DataFrame, person_days: DataFrame) -> DataFrame:
    """How people browse, by clicks per day. The unit is a person's day: ``people`` counts days, one per person if the input is one day.

    Sites and active hours of a day come from one pass over the days with a click: a bit per hour and host, then per day.
    """
    people = _per_person(us_clicks, F.floor(event_second("click_time") / DAY_S).alias("day"))
    clicked = people.select(*PERSON_DAY).distinct()
    hour = F.floor((F.col("sec") - F.col("day") * DAY_S) / 3600).cast("int")
    browsing = (
        person_days.where("own").join(clicked, list(PERSON_DAY), "left_semi")
        .groupBy(*PERSON_DAY, "host").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), hour)).alias("hours"))
        .groupBy(*PERSON_DAY).agg(F.count("host").alias("sites"), F.bit_count(F.bit_or("hours")).cast("long").alias("active_hours"))
    )
    bucket = F
    for least, label in C.CLICK_BUCKETS[:-1]:
        bucket = bucket.when(F.col("clicks") >= least, label)
    per_hour = round_half(F.col("clicks") / F.greatest("active_hours", F.lit(1)), 1)
    joined = people.join(browsing, list(PERSON_DAY))
    return joined.groupBy("brand", bucket.otherwise(C.CLICK_BUCKETS[-1][1]).alias("clicks_per_day")).agg(
        F.count("*").alias("people"),
        F.sum("clicks").alias("clicks"),
        F.sum("orders").alias("converted_clicks"),
        F.median("sites").alias("median_sites_visited"),
        F.median("active_hours").alias("median_active_hours"),
        # the middle of two one-decimal numbers has two decimals
        round_half(F.median(per_hour), 2).alias("median_clicks_per_active_hour"),
    ).select(
        "brand", "clicks_per_day", "people", "clicks", "converted_clicks",
        pct2(F.col("converted_clicks"), F.col("clicks")).alias("cr_pct"),
        "median_sites_visited", "median_active_hours", "median_clicks_per_active_hour")


def click_flooding(us_clicks: DataFrame, scale: DataFrame) -> DataFrame:
    """Share of clicks and orders by people above each threshold, and the results without them.

    Clicks are summed up once per (brand, person, clicks of the day); only those counts are tested against the thresholds.
    """
    thresholds = F.array(*[F.lit(t) for t in C.FLOOD_THRESHOLDS])
    rows = _per_person(us_clicks, "user_brand_clicks").withColumn("t", F.explode(thresholds))
    flood = F.col("user_brand_clicks") >= F.col("t")

    def total(name: str, cond=None):
        return F.sum(F.when(cond, F.col(name)).otherwise(0) if cond is not None else F.col(name))

    counts = rows.groupBy("brand", "t").agg(
        F.count_distinct(F.when(flood, F.col("user_id"))).alias("flood_people"),
        total("clicks").alias("clicks"),
        total("clicks", flood).alias("flood_clicks"),
        total("orders").alias("orders"),
        total("orders", flood).alias("flood_converted_clicks"),
        total("strong", ~flood).alias("strong_rest"),
        total("strong_orders", ~flood).alias("strong_orders_rest"),
    )
    c = F.col
    rest, rest_orders = c("clicks") - c("flood_clicks"), c("orders") - c("flood_converted_clicks")
    base = F.when(c("t") == C.FLOOD_MIN_CLICKS, " (base)").otherwise("")
    return counts.join(scale, "brand").select(
        "brand",
        F.concat(c("t").cast("string"), base).alias("threshold"),
        "flood_people", "clicks", "flood_clicks",
        pct1(c("flood_clicks"), c("clicks")).alias("pct_clicks_flood"),
        "flood_converted_clicks",
        pct1(c("flood_converted_clicks"), c("orders")).alias("pct_orders_flood"),
        pct2(c("flood_converted_clicks"), c("flood_clicks")).alias("cr_flood_pct"),
        pct2(rest_orders, rest).alias("cr_other_pct"),
        round_half(c("clicks") * c("scale_factor")).alias("est_us_affiliate_clicks"),
        round_half(rest * c("scale_factor")).alias("est_us_affiliate_clicks_excl_flood"),
        pct1(c("strong_rest"), rest).alias("pct_clicks_strong_excl_flood"),
        pct1(c("strong_orders_rest"), rest_orders).alias("pct_orders_strong_excl_flood"),
    )


def click_flood_sources(us_clicks: DataFrame) -> DataFrame:
    """Publisher and previous host of flood clicks; places with fewer than five clicks are not shown."""
    return us_clicks.where("click_flood").groupBy("brand", "publisher", "prev_host").agg(
        F.count("*").alias("flood_clicks"),
        F.count_distinct("user_id").alias("people"),
        count_where(F.col("converted")).alias("converted_clicks"),
        F.median("secs_since_prev").alias("median_secs_since_prev"),
    ).where(F.col("flood_clicks") >= C.MIN_REPORT_CLICKS)

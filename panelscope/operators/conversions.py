"""Orders, funnel steps, and which click gets the credit for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelscope import config as C
from panelscope.functions.days import days_of
from panelscope.functions.exprs import (
    count_where, decoded_or_raw, event_second, host_in, is_cart_path, is_checkout_path, second_to_ts, url_path,
)

FLAGS = ("is_cart", "is_checkout", "is_registration", "is_financing")


def conversion_events(events: DataFrame) -> DataFrame:
    """Order-confirmation pages on any host of a brand; only the URL path counts."""
    return events.where(F.col("brand").isNotNull()).where(url_path("url").rlike(C.CONVERSION_RE)).select(
        "brand", "user_id", "created_time", "host", "url")


def conversions(person_days: DataFrame) -> DataFrame:
    """One order per brand, person and run of confirmation rows no more than 30 minutes apart.

    A confirmation is an order if none came in the 30 minutes before it, so a (person, day) with the end of the
    day before is all it takes. Events without days are dealt out first.
    """
    confirmed = days_of(person_days).where(F.col("brand").isNotNull()).where(url_path("url").rlike(C.CONVERSION_RE))
    seconds = confirmed.groupBy("user_id", "day", "brand", "sec", "own").agg(F.min("url").alias("url"))
    gap = F.col("sec") - F.lag("sec").over(W.partitionBy("user_id", "day", "brand").orderBy("sec"))
    return (
        seconds.withColumn("gap", gap).where("own").where(F.col("gap").isNull() | (F.col("gap") > C.VISIT_GAP_S))
        .select("brand", "user_id", second_to_ts("sec").alias("conversion_time"), F.col("url").alias("conversion_url"))
    )


def funnel_events(events: DataFrame) -> DataFrame:
    """Cart, checkout and registration pages of a brand, and financing applications on a lender's site.

    One pass: every event yields at most one row for its own brand and one for each brand
    that a lender's URL names.
    """
    path = F.col("path")
    yes, no = F.lit(True), F.lit(False)

    def row(brand, *flags):
        return F.struct(brand.alias("brand"), *[f.alias(n) for f, n in zip(flags, FLAGS)])

    own_site = F.when(
        F.col("brand").isNotNull(),
        row(F.col("brand"), is_cart_path(path), is_checkout_path(path), path.rlike(C.REGISTRATION_RE), no),
    )
    financing = [F.when(F.col("lender_url").contains(b.name), row(F.lit(b.brand), no, no, no, yes)) for b in C.BRANDS]
    lender = host_in("host", C.FINANCING_DOMAINS)
    return (
        events.where(F.col("brand").isNotNull() | lender)
        .select("brand", "user_id", "created_time", url_path("url").alias("path"),
                F.when(lender, F.lower(decoded_or_raw(F.col("url")))).alias("lender_url"))
        .select("user_id", "created_time", F.explode(F.array_compact(F.array(own_site, *financing))).alias("f"))
        .select("f.brand", "user_id", "created_time", *[f"f.{n}" for n in FLAGS])
        .where(" OR ".join(FLAGS))
    )


def click_outcomes(clicks: DataFrame, conversions: DataFrame, funnel_events: DataFrame) -> DataFrame:
    """Last-click attribution: what each click led to before the same person's next click for the brand.

    Instead of joining every click with every later event, clicks and events are merged
    into one row per (brand, person, second); the latest click so far owns what happens in
    and after its second. Of several clicks in one second the last by key is the owner,
    and the others get nothing: their interval up to the next click is empty.
    """
    keys = ["brand", "user_id", "sec"]
    click_rows = clicks.select("brand", "user_id", event_second("click_time").alias("sec"), "click_key")
    order_rows = conversions.select(
        "brand", "user_id", event_second("conversion_time").alias("sec"), F.lit(True).alias("ordered"))
    funnel_rows = funnel_events.select("brand", "user_id", event_second("created_time").alias("sec"), *FLAGS)
    after = order_rows.unionByName(funnel_rows, allowMissingColumns=True)
    seconds = click_rows.unionByName(after, allowMissingColumns=True).groupBy(*keys).agg(
        F.max("click_key").alias("click_key"), F.bool_or("ordered").alias("ordered"),
        *[F.bool_or(f).alias(f) for f in FLAGS])
    so_far = W.partitionBy("brand", "user_id").orderBy("sec").rowsBetween(W.unboundedPreceding, W.currentRow)
    owned = (
        seconds.withColumn("owner", F.last("click_key", ignorenulls=True).over(so_far))
        .where(F.col("owner").isNotNull())
        .groupBy("brand", F.col("owner").alias("click_key")).agg(
            F.min(F.when(F.col("ordered"), F.col("sec"))).alias("order_sec"),
            *[F.bool_or(f).alias(f) for f in FLAGS])
    )
    joined = clicks.select("brand", "click_key").join(owned, ["brand", "click_key"], "left")

    def flag(name):
        return F.coalesce(F.col(name), F.lit(False))

    converted = F.col("order_sec").isNotNull()
    return joined.select(
        "brand", "click_key",
        second_to_ts("order_sec").alias("conversion_time"),
        converted.alias("converted"),
        flag("is_cart").alias("reached_cart"),
        flag("is_checkout").alias("reached_checkout"),
        flag("is_registration").alias("registered"),
        flag("is_financing").alias("applied_financing"),
        (converted | flag("is_registration") | flag("is_financing")).alias("converted_broad"),
    )


def brand_funnel(brands: DataFrame, events: DataFrame, funnel_events: DataFrame, conversions: DataFrame) -> DataFrame:
    """Distinct persons per brand at each step, all traffic.

    One row per (brand, person) with a flag per step, then plain counts: a single shuffle
    of the three inputs instead of six distinct counts.
    """
    steps = ("visited", *FLAGS, "ordered")
    yes = F.lit(True)
    rows = (
        events.where("is_brand_page").select("brand", "user_id", yes.alias("visited"))
        .unionByName(funnel_events.select("brand", "user_id", *FLAGS), allowMissingColumns=True)
        .unionByName(conversions.select("brand", "user_id", yes.alias("ordered")), allowMissingColumns=True)
    )
    per_user = rows.groupBy("brand", "user_id").agg(*[F.bool_or(s).alias(s) for s in steps])
    names = ("visitors", "reached_cart", "reached_checkout", "registered", "applied_financing", "ordered")
    counts = per_user.groupBy("brand").agg(*[count_where(F.col(s)).alias(n) for s, n in zip(steps, names)])
    return brands.select("brand").join(counts, "brand", "left").select(
        "brand", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])

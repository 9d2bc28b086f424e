"""Who is in the panel, what it sees, and whether that bends the hijacking result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelscope import config as C
from panelscope.functions.exprs import count_where, host_in, pct, ratio, round_half
from panelscope.operators.summary import pct1


def panel_activity(panel_users: DataFrame) -> DataFrame:
    tier = F
    for limit, label in C.ACTIVITY_TIERS[:-1]:
        tier = tier.when(F.col("events") <= limit, label)
    return panel_users.select("user_id", "events", tier.otherwise(C.ACTIVITY_TIERS[-1][1]).alias("activity_tier"))


def panel_profile(panel_users: DataFrame, alias: DataFrame, events: DataFrame) -> DataFrame:
    """One row: panel size, mirrors, US share, spread and concentration of activity, sessions per person.

    Ranks and percentiles come from the histogram of events per user. A histogram of a total
    of N events has at most sqrt(2 N) bars, so its unpartitioned window stays small at any scale.
    """
    bars = panel_users.groupBy("events").agg(
        F.count("*").alias("users"), count_where(F.col("is_us")).alias("us"))
    ascending = W.orderBy("events").rowsBetween(W.unboundedPreceding, W.currentRow)
    everyone = W.partitionBy()
    bars = bars.select(
        "events", "users", "us",
        F.sum("users").over(ascending).alias("upto"),
        F.sum("users").over(everyone).alias("n"),
        F.sum(F.col("users") * F.col("events")).over(everyone).alias("total"),
    )
    n, users, upto = F.col("n"), F.col("users"), F.col("upto")
    above = n - upto

    def top_share(percent: int) -> Column:
        """Share of all events made by the busiest ``percent`` % of users; the bar at the cut counts in part."""
        quota = F.floor(n * percent / 100)
        taken = F.greatest(F.lit(0), F.least(users, quota - above))
        return round_half(pct(F.sum(F.when(taken > 0, taken * F.col("events"))), F.max("total")), 1)

    def percentile(q: float) -> Column:
        """Continuous percentile: the two users around rank (n - 1) q, weighted by their distance to it."""
        rank = (n - 1).cast("double") * q
        share = F.max(rank - F.floor(rank))

        def value_at(r: Column) -> Column:
            return F.max(F.when((upto - users <= r) & (r < upto), F.col("events"))).cast("double")

        return value_at(F.floor(rank)) * (F.lit(1.0) - share) + value_at(F.ceil(rank)) * share

    # one group-by per count: two distinct counts in one aggregate would double its rows
    sessions, persons = (
        events.where(F.col(c).isNotNull()).groupBy(c).agg(F.lit(1).alias("one")).agg(F.count("one")).scalar()
        for c in ("session_id", "user_id"))
    mirrors = alias.agg(F.count("*")).scalar()
    return bars.agg(
        F.coalesce(F.sum("users"), F.lit(0)).alias("panel_user_ids"),
        F.coalesce(F.sum("us"), F.lit(0)).alias("us_user_ids"),
        percentile(0.5).alias("events_p50"), percentile(0.9).alias("events_p90"), percentile(0.99).alias("events_p99"),
        F.max("events").alias("events_max"),
        top_share(1).alias("pct_events_top1pct_users"), top_share(10).alias("pct_events_top10pct_users"),
        F.coalesce(F.sum(F.when(F.col("events") > C.EXTREME_EVENTS, users)), F.lit(0)).alias("users_over_5000_events"),
    ).withColumns({"mirror_ids_merged_brand_users": mirrors, "s": sessions, "u": persons}).withColumns({
        "pct_us": pct1(F.col("us_user_ids"), F.col("panel_user_ids")),
        "sessions_per_brand_user": round_half(ratio(F.col("s"), F.col("u")), 2),
    }).select(
        "panel_user_ids", "mirror_ids_merged_brand_users", "us_user_ids", "pct_us", "events_p50", "events_p90",
        "events_p99", "events_max", "pct_events_top1pct_users", "pct_events_top10pct_users", "users_over_5000_events",
        "sessions_per_brand_user")


def coverage_sites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(C.COVERAGE_SITES), "site string, kind string")


def panel_coverage(activity: DataFrame, sites: DataFrame) -> DataFrame:
    """Distinct users of each named site (exact host); sites nobody visited count zero.

    The stored activity has a bit per named site, so a user's sites are one number, and the join only sees one row per site.
    """
    users = activity.where(F.col("user_id").isNotNull() & (F.col("sites") != 0)).groupBy("user_id").agg(F.bit_or("sites").alias("sites"))
    names = F.array_compact(F.array(*[
        F.when(F.col("sites").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(site)) for i, (site, _) in enumerate(C.COVERAGE_SITES)]))
    counts = users.select(F.explode(names).alias("site")).groupBy("site").agg(F.count("*").alias("panel_users"))
    return sites.join(counts, "site", "left").select(
        "site", "kind", F.coalesce("panel_users", F.lit(0)).alias("panel_users"))


def coupon_extension_users(events: DataFrame) -> DataFrame:
    return events.where(host_in("host", C.COUPON_DOMAINS)).select("user_id").distinct()


def _per_person(us_clicks: DataFrame, coupon_users: DataFrame, brand: str) -> DataFrame:
    strong, conv = F.col("strong_hijack_signal"), F.col("converted")
    people = us_clicks.where(F.col("brand") == brand).groupBy("user_id").agg(
        F.count("*").alias("clicks"), count_where(strong).alias("flagged"),
        count_where(conv).alias("orders"), count_where(strong & conv).alias("flagged_orders"))
    marked = coupon_users.withColumn("coupon_user", F.lit(True))
    return people.join(marked, "user_id", "left").withColumn("coupon_user", F.coalesce("coupon_user", F.lit(False)))


def hijack_by_segment(us_clicks: DataFrame, coupon_users: DataFrame, activity: DataFrame,
                      brand: str = C.RETAIL_BRAND) -> DataFrame:
    """Flagged share of clicks and orders by coupon use and by activity; clicks are counted per person first."""
    people = _per_person(us_clicks, coupon_users, brand).join(activity.drop("events"), "user_id")
    yes_no = F.when(F.col("coupon_user"), "Yes").otherwise("No")
    segments = F.array(
        F.struct(F.lit(C.SEGMENT_COUPON).alias("dimension"), yes_no.alias("segment")),
        F.struct(F.lit(C.SEGMENT_ACTIVITY).alias("dimension"), F.col("activity_tier").alias("segment")),
    )
    return (
        people.withColumn("s", F.explode(segments)).groupBy("s.dimension", "s.segment").agg(
            F.count("*").alias("users"),
            *[F.sum(c).alias(c) for c in ("clicks", "flagged", "orders", "flagged_orders")])
        .withColumns({
            "pct_clicks_flagged": pct1(F.col("flagged"), F.col("clicks")),
            "pct_orders_flagged": pct1(F.col("flagged_orders"), F.col("orders")),
        }).select("dimension", "segment", "users", "clicks", "pct_clicks_flagged", "orders", "pct_orders_flagged")
    )


def hijack_reweighted(us_clicks: DataFrame, coupon_users: DataFrame, brand: str = C.RETAIL_BRAND) -> DataFrame:
    """Flagged share of orders when coupon users count less, as if the panel held too many of them."""
    groups = _per_person(us_clicks, coupon_users, brand).groupBy("coupon_user").agg(
        F.sum("orders").alias("orders"), F.sum("flagged_orders").alias("flagged"))
    weights = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(label).alias("label")) for w, label in C.COUPON_WEIGHTS])
    rows = groups.withColumn("x", F.explode(weights))
    weight = F.when(F.col("coupon_user"), F.col("x.w")).otherwise(1.0)

    def weighted(name: str) -> Column:
        return F.sum(F.when(F.col(name) > 0, F.col(name) * weight))

    return rows.groupBy(F.col("x.label").alias("coupon_user_weight")).agg(
        pct1(weighted("flagged"), weighted("orders")).alias("pct_orders_flagged"))

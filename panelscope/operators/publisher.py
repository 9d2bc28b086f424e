"""Data behind a publisher-risk monitor: click facts, masked journeys, and a payout status per publisher."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelscope import config as C
from panelscope.functions.exprs import count_where, event_second, host_in, registered_domain, url_section
from panelscope.functions.joins import keep_members
from panelscope.operators.summary import pct1


def named_sites(events: DataFrame) -> DataFrame:
    """Hosts that may be shown: 20 or more persons, or a brand, redirect, mattress or review site."""
    per_user = events.groupBy("host", "user_id").agg(
        F.bool_or(F.col("is_brand_page") | F.col("hop_brand").isNotNull()).alias("open"))
    category = registered_domain("host").isin(*[f"{b}.com" for b in C.MATTRESS_BRANDS]) | host_in(
        "host", C.REVIEW_DOMAINS)
    return (
        per_user.groupBy("host").agg(F.count("*").alias("users"), F.bool_or("open").alias("open"))
        .where((F.col("users") >= C.MIN_SITE_USERS) | F.col("open") | category)
        .select("host")
    )


def _masked(df: DataFrame, column: str, named_sites: DataFrame, out: str) -> DataFrame:
    """Replace hosts that may not be named. The list of named hosts grows with the data: Spark picks the join."""
    sites = named_sites.select(F.col("host").alias(column), F.lit(True).alias("_named"))
    host = F.col(column)
    network = host_in(host, C.NETWORK_SITE_DOMAINS, C.NETWORK_SITE_HOSTS)
    visible = ~host.rlike(C.ADULT_HOST_RE) & (F.col("_named").isNotNull() | network)
    shown = F.when(host.isNull(), F.lit(None)).when(visible, host).otherwise(C.OTHER_SITE)
    return df.join(sites, column, "left").withColumn(out, shown).drop("_named")


def monitor_clicks(us_clicks: DataFrame, click_stage: DataFrame, named_sites: DataFrame) -> DataFrame:
    """One row per click with its outcome, raw indicator timings and stage; no person ids and no full URLs."""
    joined = us_clicks.join(click_stage.select("brand", "click_key", "stage_at_click"), ["brand", "click_key"])
    facts = joined.select(
        "brand", "click_key", "network", "publisher",
        F.date_format("click_time", "HH:mm:ss").alias("t"),
        "converted",
        (event_second("conversion_time") - event_second("click_time")).alias("secs_to_order"),
        "no_landing",
        F.col("has_paid_search_click_id").alias("paid_search"),
        "secs_since_checkout", "secs_since_brand_page", "brand_search_60s", "coupon_ext_60s", "multi_brand_burst",
        "no_referrer", "prev_host",
        F.col("coupon").isNotNull().alias("has_coupon"),
        F.when(~F.col("no_landing"), url_section(F.coalesce("landing_url", F.lit("")))).alias("landing_section"),
        F.substring("stage_at_click", 1, 1).cast("long").alias("stage"),
    )
    return _masked(facts, "prev_host", named_sites, "prev_site").drop("prev_host")


def site_steps(us_clicks: DataFrame, events: DataFrame) -> DataFrame:
    """Events of click users as places (host, and section on the brand's own site), one row per second and place.

    Built once per brand that a person clicked for, since only that brand's site is split
    into sections. ``change`` marks a place that differs from the one before it (``carried``:
    the last place of the previous second ``prev_sec``), ``first`` the first place of its
    second, ``own`` rows that may be the click itself. ``up`` and ``down`` number the
    changes of a second from its first and from its last place.
    """
    second = ["brand", "user_id", "sec"]
    who = us_clicks.select(F.col("brand").alias("clicked"), "user_id").distinct()
    seen = (
        keep_members(events, us_clicks.select("user_id").distinct(), "user_id")
        .select("user_id", event_second("created_time").alias("sec"), "host", "hop_brand",
                F.when(F.col("is_brand_page"), F.col("brand")).alias("site_brand"),
                F.when(F.col("is_brand_page"), url_section("url")).alias("part")).distinct()
    )
    on_site = F.col("site_brand") == F.col("clicked")
    places = (
        seen.join(who, "user_id")
        .select(F.col("clicked").alias("brand"), "user_id", "sec", "host", F.when(on_site, F.col("part")).alias("section"),
                F.coalesce((F.col("hop_brand") == F.col("clicked")) | on_site, F.lit(False)).alias("own"))
        .groupBy(*second, "host", "section").agg(F.bool_and("own").alias("own"))
        .withColumn("place", F.struct("host", F.coalesce("section", F.lit("")).alias("part")))
    )
    over_time = W.partitionBy("brand", "user_id").orderBy("sec")
    ends = places.groupBy(*second).agg(F.max("place").alias("last_place")).select(
        *second, F.lag("last_place").over(over_time).alias("carried"), F.lag("sec").over(over_time).alias("prev_sec"))
    in_second = W.partitionBy(*second).orderBy("place")
    before_it = F.lag("place").over(in_second)
    marked = places.join(ends, second).select(
        "*", before_it.isNull().alias("first"),
        F.coalesce(F.col("place") != F.coalesce(before_it, "carried"), F.lit(True)).alias("change"))
    upto, everything = (W.partitionBy(*second).orderBy("place").rowsBetween(W.unboundedPreceding, end)
                        for end in (W.currentRow, W.unboundedFollowing))
    changes = F.when(F.col("change"), 1).otherwise(0).cast("long")
    up = F.sum(changes).over(upto)
    return marked.select(
        "*", up.alias("up"), (F.sum(changes).over(everything) - up + 1).alias("down"))


def site_timeline(us_clicks: DataFrame, site_steps: DataFrame) -> DataFrame:
    """One row per (brand, person, second) with events, and per second 30 minutes before a click.

    ``n`` changes of place in the second and ``base`` before it, the first second with
    events ``from_here`` on, and the ``next_sec`` with events after it.
    """
    second = ["brand", "user_id", "sec"]
    edges = us_clicks.select(
        "brand", "user_id", (event_second("click_time") - C.CONTEXT_BEFORE_S).alias("sec")).distinct()
    seconds = (
        site_steps.select(*second, F.col("change").cast("int").alias("n"), F.lit(True).alias("active"))
        .unionByName(edges, allowMissingColumns=True)
        .groupBy(*second).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.bool_or("active").alias("active"))
    )
    forwards, backwards = (W.partitionBy("brand", "user_id").orderBy(o) for o in ("sec", F.desc("sec")))
    active = F.when(F.col("active"), F.col("sec"))
    return seconds.select(
        *second, "n",
        F.coalesce(F.sum("n").over(forwards.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.min(active).over(backwards.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("from_here"),
        F.min(active).over(backwards.rowsBetween(W.unboundedPreceding, -1)).alias("next_sec"),
    )


def click_journey(us_clicks: DataFrame, site_steps: DataFrame, timeline: DataFrame) -> DataFrame:
    """The last six sites before each click and the first two after it, repeats of one site and section merged.

    Events of the click's own second count as before, except the click's own rows.

    Clicks are not joined with all events around them. The changes of place of a (brand,
    person) are numbered over time; a click looks up the six changes before it and the two
    after it by number. A run of one place that reaches into the window from outside is
    added by its first second in the window. All ordering inside a second stays in groups
    of one second, and groups over time hold one row per second.
    """
    second = ["brand", "user_id", "sec"]
    at = us_clicks.select("brand", "user_id", event_second("click_time").alias("sec")).distinct()
    numbered = site_steps.where("change").join(timeline.select(*second, "base"), second).select(
        *second, "host", "section", (F.col("base") + F.col("up")).alias("up"),
        (F.col("base") + F.col("down")).alias("down"))
    window_start = timeline.select("brand", "user_id", (F.col("sec") + C.CONTEXT_BEFORE_S).alias("sec"),
                                   F.col("from_here").alias("first_sec"))
    points = at.join(timeline, second).join(window_start, second).withColumnRenamed("sec", "click_sec")

    def step(df: DataFrame, before: bool) -> DataFrame:
        return df.select("brand", "user_id", "click_sec", "host", "section", "sec", F.lit(before).alias("before"))

    base, upto = F.col("base"), F.col("base") + F.col("n")
    last_changes = F.explode(F.sequence(F.greatest(base - (C.JOURNEY_STEPS_BEFORE - 1), F.lit(1)), base))
    next_changes = F.explode(F.sequence(upto + 1, upto + C.JOURNEY_STEPS_AFTER))
    in_window = F.col("sec") >= F.col("click_sec") - C.CONTEXT_BEFORE_S
    in_reach = F.col("sec") <= F.col("click_sec") + C.CONTEXT_AFTER_S
    earlier = (
        points.where(base > 0).select("brand", "user_id", "click_sec", last_changes.alias("down"))
        .join(numbered.drop("up"), ["brand", "user_id", "down"]).where(in_window)
    )
    later = (
        points.select("brand", "user_id", "click_sec", next_changes.alias("up"))
        .join(numbered.drop("down"), ["brand", "user_id", "up"]).where(in_reach)
    )
    # First rows of a side that continue a run begun outside it.
    running_on = site_steps.where("first AND NOT change").select(*second, "host", "section")
    reach_in = points.where("first_sec < click_sec").select(
        "brand", "user_id", "click_sec", F.col("first_sec").alias("sec")).join(running_on, second)
    reach_out = points.select(
        "brand", "user_id", "click_sec", F.col("next_sec").alias("sec")).join(running_on, second).where(in_reach)
    # The click's own second, without the click's own rows.
    in_second = W.partitionBy(*second).orderBy("place")
    recent = F.when(F.col("prev_sec") >= F.col("sec") - C.CONTEXT_BEFORE_S, F.col("carried"))
    before_it = F.coalesce(F.lag("place").over(in_second), recent)
    same_second = (
        site_steps.where(~F.col("own")).join(at, second, "left_semi")
        .withColumn("before_it", before_it).where(F.coalesce(F.col("place") != F.col("before_it"), F.lit(True)))
        .withColumn("click_sec", F.col("sec"))
    )

    steps = step(earlier, True)
    for part, before in ((reach_in, True), (same_second, True), (later, False), (reach_out, False)):
        steps = steps.unionByName(step(part, before))
    nearest = W.partitionBy("brand", "user_id", "click_sec", "before").orderBy(
        F.abs(F.col("sec") - F.col("click_sec")), "host", F.col("section").asc_nulls_last())
    limit = F.when(F.col("before"), C.JOURNEY_STEPS_BEFORE).otherwise(C.JOURNEY_STEPS_AFTER)
    top = steps.withColumn("k", F.row_number().over(nearest)).where(F.col("k") <= limit)
    keys = us_clicks.select("brand", "user_id", "click_key", event_second("click_time").alias("click_sec"))
    return keys.join(top, ["brand", "user_id", "click_sec"]).select(
        "brand", "click_key", "host", "section", (F.col("click_sec") - F.col("sec")).alias("secs_before"), "before")


def masked_journey(click_journey: DataFrame, named_sites: DataFrame) -> DataFrame:
    """Journeys with rare and adult hosts masked; masked steps that now repeat are merged."""
    masked = _masked(click_journey, "host", named_sites, "site")
    order = W.partitionBy("brand", "click_key", "before").orderBy(
        F.desc("secs_before"), "host", F.col("section").asc_nulls_last())
    shown = F.struct("site", "section")
    kept = masked.withColumn("repeat", shown.eqNullSafe(F.lag(shown).over(order))).where(~F.col("repeat"))
    return kept.withColumn("step", F.row_number().over(order).cast("long")).select(
        "brand", "click_key", "before", "step", "site", "section", F.abs("secs_before").alias("secs_from_click"))


def publisher_risk_status(us_clicks: DataFrame) -> DataFrame:
    """Payout status and commission on flagged orders per brand, publisher and look-back.

    Hold: any click without a landing, or three or more orders with half or more flagged.
    Review: a fifth or more of the clicks flagged, or any flagged order. Otherwise OK.
    """
    look_backs = F.array(*[F.struct(F.lit(s).alias("secs"), F.lit(label).alias("look_back")) for s, label in C.LOOK_BACKS])

    def recent(name: str) -> Column:
        return F.coalesce(F.col(name) <= F.col("w.secs"), F.lit(False))

    flagged = (F.col("no_landing") | F.col("has_paid_search_click_id") | recent("secs_since_checkout")
               | recent("secs_since_brand_page"))
    counts = us_clicks.withColumn("w", F.explode(look_backs)).groupBy("brand", "publisher", "w.look_back").agg(
        F.count("*").alias("clicks"),
        count_where(flagged).alias("flagged_clicks"),
        count_where(F.col("converted")).alias("orders"),
        count_where(flagged & F.col("converted")).alias("flagged_orders"),
        count_where(F.col("no_landing")).alias("no_landing_clicks"),
    )
    c = F.col
    per_order = F
    for brand, aov, commission in C.ECONOMICS:
        per_order = per_order.when(c("brand") == brand, aov * commission / 100.0)
    hold = (c("no_landing_clicks") > 0) | (
        (c("orders") >= C.HOLD_MIN_ORDERS) & (c("flagged_orders") * 100 >= c("orders") * C.HOLD_FLAGGED_PCT))
    review = (c("flagged_clicks") * 100 >= c("clicks") * C.REVIEW_FLAGGED_PCT) | (c("flagged_orders") > 0)
    labels = C.STATUS_LABELS
    return counts.withColumns({
        "pct_clicks_flagged": pct1(c("flagged_clicks"), c("clicks")),
        "commission_on_flagged_orders": c("flagged_orders") * per_order.otherwise(F.lit(None).cast("double")),
        "status": F.when(hold, labels[0]).when(review, labels[1]).otherwise(labels[2]),
    })

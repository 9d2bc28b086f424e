"""Result tables per brand, publisher, signal and traffic source (US persons)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelscope import config as C
from panelscope.functions.exprs import byar_high, byar_low, count_where, event_second, pct, ratio, round_half
from panelscope.operators.scaling import us_visits

_COL = F.col


def pct1(n: Column, d: Column) -> Column:
    return round_half(pct(n, d), 1)


def pct2(n: Column, d: Column) -> Column:
    return round_half(pct(n, d), 2)


def us_clicks(risk: DataFrame, outcomes: DataFrame, us_users: DataFrame) -> DataFrame:
    """Clicks of US persons with outcome and risk. Almost every report reads this table."""
    return (
        risk.drop("other_advertisers_2m").join(us_users, "user_id", "left_semi")
        .join(outcomes, ["brand", "click_key"])
    )


def competitor_summary(brands: DataFrame, scale: DataFrame, visits: DataFrame, us_clicks: DataFrame,
                       conversions: DataFrame, us_users: DataFrame) -> DataFrame:
    """One row per brand: traffic, clicks, outcomes, and US estimates with 95 % intervals of the panel count.

    Distinct persons and publishers come from clicks grouped by (brand, person, publisher,
    network), so nothing is expanded once per distinct count.
    """
    strong, flood = _COL("strong_hijack_signal"), _COL("click_flood")
    fine = us_clicks.groupBy("brand", "user_id", "publisher", "network").agg(
        F.count("*").alias("clicks"),
        count_where(_COL("no_landing")).alias("no_landing"),
        count_where(_COL("reached_cart") | _COL("reached_checkout")).alias("to_cart"),
        count_where(_COL("converted")).alias("converted"),
        count_where(_COL("converted_broad")).alias("broad"),
        count_where(strong).alias("strong"),
        count_where(flood).alias("flood"),
        count_where(strong & ~flood).alias("strong_rest"),
    )
    sums = ("clicks", "no_landing", "to_cart", "converted", "broad", "strong", "flood", "strong_rest")
    per_publisher = fine.groupBy("brand", "publisher", "network").agg(*[F.sum(s).alias(s) for s in sums])
    totals = per_publisher.groupBy("brand").agg(
        *[F.sum(s).alias(s) for s in sums],
        F.count_distinct("publisher").alias("publishers"),
        F.array_join(F.array_sort(F.collect_set("network")), ", ").alias("networks"),
    )
    people = fine.select("brand", "user_id").distinct().groupBy("brand").agg(F.count("*").alias("click_users"))
    orders = conversions.join(us_users, "user_id", "left_semi").groupBy("brand").agg(F.count("*").alias("orders"))
    wide = (
        brands.select("brand", "is_client").join(scale, "brand")
        .join(us_visits(visits, us_users), "brand", "left")
        .join(totals, "brand", "left").join(people, "brand", "left").join(orders, "brand", "left")
    )

    def n(name: str) -> Column:
        return F.coalesce(_COL(name), F.lit(0))

    factor, clicks, converted = _COL("scale_factor"), n("clicks"), n("converted")
    few_orders = converted < C.MIN_ORDERS_FOR_RATE

    def estimate(x: Column, by: Column = factor) -> Column:
        return round_half(x.cast("double") * by)

    def benchmark(rate: float) -> Column:
        return F.when(few_orders, round_half(clicks.cast("double") * factor * rate))

    return wide.select(
        "brand", "is_client", "networks",
        n("visits").alias("panel_visits"),
        clicks.alias("panel_affiliate_clicks"),
        n("no_landing").alias("panel_clicks_no_landing"),
        n("click_users").alias("panel_affiliate_users"),
        n("publishers").alias("panel_publishers"),
        converted.alias("panel_converted_clicks"),
        n("broad").alias("panel_converted_clicks_broad"),
        n("orders").alias("panel_conversions_all_sources"),
        pct1(_COL("affiliate_entry_visits"), _COL("visits")).alias("pct_visits_from_affiliate"),
        pct1(_COL("to_cart"), _COL("clicks")).alias("pct_clicks_reaching_cart_or_checkout"),
        pct2(_COL("converted"), _COL("clicks")).alias("pct_clicks_converting"),
        pct1(_COL("converted"), _COL("orders")).alias("pct_orders_affiliate_attributed"),
        pct1(_COL("strong"), _COL("clicks")).alias("pct_clicks_strong_hijack_signal"),
        round_half(factor).alias("scale_factor"),
        estimate(clicks).alias("est_us_affiliate_clicks"),
        estimate(byar_low(clicks)).alias("est_us_affiliate_clicks_lo95"),
        estimate(byar_high(clicks)).alias("est_us_affiliate_clicks_hi95"),
        estimate(clicks, _COL("scale_factor_alt")).alias("est_us_affiliate_clicks_alt"),
        estimate(converted).alias("est_us_converted_clicks"),
        estimate(byar_high(converted)).alias("est_us_converted_clicks_hi95"),
        benchmark(C.BENCHMARK_CR_LOW).alias("est_us_converted_clicks_benchmark_lo"),
        benchmark(C.BENCHMARK_CR_HIGH).alias("est_us_converted_clicks_benchmark_hi"),
        n("flood").alias("panel_clicks_flood"),
        pct1(_COL("flood"), _COL("clicks")).alias("pct_clicks_flood"),
        pct1(_COL("strong_rest"), _COL("clicks") - _COL("flood")).alias("pct_clicks_strong_hijack_signal_excl_flood"),
        estimate(clicks - n("flood")).alias("est_us_affiliate_clicks_excl_flood"),
    )


def traffic_mix(visit_sources: DataFrame, us_users: DataFrame) -> DataFrame:
    """Visits by entry source and their share within the brand."""
    counts = visit_sources.join(us_users, "user_id", "left_semi").groupBy("brand", "entry_source").agg(
        F.count("*").alias("visits"))
    total = F.sum("visits").over(W.partitionBy("brand"))
    return counts.withColumn("pct_of_brand_visits", pct1(_COL("visits"), total))


def publisher_summary(us_clicks: DataFrame) -> DataFrame:
    """Clicks, outcomes and indicators per brand, network and publisher.

    Grouped per person first: the distinct count of persons becomes a plain count, and a
    publisher with a third of all clicks is spread over its people.
    """
    flags = {
        "clicks_to_cart_or_checkout": _COL("reached_cart") | _COL("reached_checkout"),
        "converted_clicks": _COL("converted"),
        "no_landing": _COL("no_landing"),
        "injected_at_checkout": _COL("in_checkout_before"),
        "already_on_site": _COL("already_on_site"),
        "paid_search_click_id": _COL("has_paid_search_click_id"),
        "brand_search_before": _COL("brand_search_60s"),
        "coupon_before": _COL("coupon_ext_60s"),
        "burst": _COL("multi_brand_burst"),
        "no_referrer": _COL("no_referrer"),
        "strong": _COL("strong_hijack_signal"),
        "flood_clicks": _COL("click_flood"),
    }
    key = ["brand", "network", "publisher"]
    per_user = us_clicks.groupBy(*key, "user_id").agg(
        F.count("*").alias("clicks"),
        *[count_where(cond).alias(name) for name, cond in flags.items()],
        F.min("publisher_sub_id").alias("sub_id"), F.min("coupon").alias("cpn"),
    )
    return per_user.groupBy(*key).agg(
        F.sum("clicks").alias("clicks"),
        F.count("*").alias("users"),
        *[F.sum(name).alias(name) for name in flags],
        F.min("sub_id").alias("example_sub_id"),
        F.min("cpn").alias("example_coupon"),
    ).withColumns({
        "clicks_per_user": round_half(ratio(_COL("clicks"), _COL("users")), 1),
        "pct_strong_signal": pct1(_COL("strong"), _COL("clicks")),
    }).select(*key, "clicks", "users", "clicks_per_user", *[f for f in flags if f not in ("strong", "flood_clicks")],
              "pct_strong_signal", "flood_clicks", "example_sub_id", "example_coupon")


def signal_summary(us_clicks: DataFrame) -> DataFrame:
    """Clicks and orders per brand and first-ranked signal, with shares within the brand."""
    counts = us_clicks.groupBy("brand", "primary_signal").agg(
        F.count("*").alias("clicks"), count_where(_COL("converted")).alias("converted_clicks"))
    brand = W.partitionBy("brand")
    return counts.withColumns({
        "cr_pct": pct2(_COL("converted_clicks"), _COL("clicks")),
        "pct_of_clicks": pct1(_COL("clicks"), F.sum("clicks").over(brand)),
        "pct_of_converted_clicks": pct1(_COL("converted_clicks"), F.sum("converted_clicks").over(brand)),
    })


def flagged_click_sources(us_clicks: DataFrame) -> DataFrame:
    """Where flagged clicks come from; places with fewer than five clicks are not shown."""
    return us_clicks.where(_COL("strong_hijack_signal") | _COL("coupon_ext_60s")).groupBy(
        "brand", "primary_signal", "prev_host").agg(
        F.count("*").alias("clicks"),
        count_where(_COL("converted")).alias("converted_clicks"),
        F.median("secs_since_prev").alias("median_secs_since_prev"),
    ).where(_COL("clicks") >= C.MIN_REPORT_CLICKS)


def hijack_sensitivity(us_clicks: DataFrame) -> DataFrame:
    """The flagged share of clicks and orders under shorter look-backs."""
    look_backs = F.array(*[F.struct(F.lit(s).alias("secs"), F.lit(label).alias("look_back"))
                           for s, label in C.LOOK_BACKS])

    def recent(name: str) -> Column:
        return F.coalesce(_COL(name) <= _COL("w.secs"), F.lit(False))

    checkout = recent("secs_since_checkout")
    strong = _COL("no_landing") | _COL("has_paid_search_click_id") | checkout | recent("secs_since_brand_page")
    rows = us_clicks.withColumn("w", F.explode(look_backs)).select(
        "brand", "w.look_back", "converted", "click_flood", checkout.alias("checkout"), strong.alias("strong"),
        (event_second("conversion_time") - event_second("click_time")).alias("to_order"))
    conv, flood, check, flag = (_COL(c) for c in ("converted", "click_flood", "checkout", "strong"))
    counts = rows.groupBy("brand", "look_back").agg(
        F.count("*").alias("clicks"),
        count_where(flag).alias("flagged"),
        count_where(flag & conv).alias("flagged_orders"),
        count_where(conv).alias("orders"),
        count_where(check).alias("at_checkout"),
        count_where(check & conv).alias("checkout_orders"),
        F.median(F.when(check & conv, _COL("to_order"))).alias("median_s"),
        count_where(flag & ~flood).alias("flagged_rest"),
        count_where(~flood).alias("rest"),
        count_where(flag & conv & ~flood).alias("flagged_orders_rest"),
        count_where(conv & ~flood).alias("orders_rest"),
    )
    return counts.select(
        "brand", "look_back", "clicks",
        pct1(_COL("flagged"), _COL("clicks")).alias("pct_clicks_strong"),
        pct2(_COL("flagged_orders"), _COL("flagged")).alias("cr_strong_pct"),
        pct2(_COL("orders") - _COL("flagged_orders"), _COL("clicks") - _COL("flagged")).alias("cr_other_pct"),
        pct1(_COL("flagged_orders"), _COL("orders")).alias("pct_orders_from_strong"),
        pct1(_COL("at_checkout"), _COL("clicks")).alias("pct_clicks_checkout"),
        pct2(_COL("checkout_orders"), _COL("at_checkout")).alias("cr_checkout_pct"),
        round_half(_COL("median_s") / 60.0, 1).alias("median_min_to_order_checkout"),
        pct1(_COL("flagged_rest"), _COL("rest")).alias("pct_clicks_strong_excl_flood"),
        pct1(_COL("flagged_orders_rest"), _COL("orders_rest")).alias("pct_orders_from_strong_excl_flood"),
    )

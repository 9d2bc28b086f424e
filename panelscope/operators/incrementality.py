"""Do clicks fired at the cart or checkout add orders, and what do flagged orders cost?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelscope import config as C
from panelscope.functions.exprs import (
    byar_high, byar_low, count_where, event_second, ratio, round_half, second_to_ts,
)
from panelscope.operators.summary import pct1

INJECTED, CONTROL = C.GROUP_INJECTED, C.GROUP_CONTROL


def checkout_anchors(funnel_events: DataFrame, us_users: DataFrame, conversions: DataFrame, us_clicks: DataFrame,
                     brand: str = C.RETAIL_BRAND) -> DataFrame:
    """First cart and first checkout view per US person and day, with the order and the clicks around it.

    A person has at most two anchors a day, so the joins with orders and clicks only double them;
    both are reduced to one row per anchor at once.
    """
    of_brand = F.col("brand") == brand
    views = (
        funnel_events.where(of_brand).where("is_cart OR is_checkout")
        .select("user_id", event_second("created_time").alias("sec"), F.to_date("created_time").alias("day"), "is_checkout")
        .join(us_users, "user_id", "left_semi")
    )
    firsts = views.groupBy("user_id", "day").agg(
        F.min(F.when(F.col("is_checkout"), F.col("sec"))).alias("checkout"),
        F.min(F.when(~F.col("is_checkout"), F.col("sec"))).alias("cart"),
    )
    cart = F.when(F.col("checkout").isNull() | (F.col("cart") < F.col("checkout")), F.col("cart"))

    def anchor_row(stage: str, sec: Column) -> Column:
        return F.when(sec.isNotNull(), F.struct(F.lit(stage).alias("stage"), sec.alias("anchor")))

    anchors = firsts.select(
        "user_id",
        F.explode(F.array_compact(F.array(anchor_row("checkout", F.col("checkout")), anchor_row("cart", cart)))).alias("a"),
    ).select("user_id", "a.stage", "a.anchor")

    key, anchor = ["user_id", "stage", "anchor"], F.col("anchor")
    order_sec = event_second("conversion_time").alias("order_sec")
    orders = (
        anchors.join(conversions.where(of_brand).select("user_id", order_sec), "user_id")
        .where((F.col("order_sec") > anchor) & (F.col("order_sec") <= anchor + C.ANCHOR_ORDER_S))
        .groupBy(*key).agg(F.min("order_sec").alias("order_sec"))
    )
    click_sec = event_second("click_time").alias("click_sec")
    click = F.col("click_sec")
    touches = (
        anchors.join(us_clicks.where(of_brand).select("user_id", click_sec), "user_id")
        .groupBy(*key).agg(
            F.bool_or(click.between(anchor - C.ANCHOR_REFERRED_S, anchor)).alias("referred"),
            F.min(F.when(click > anchor, click)).alias("next_click"))
    )
    horizon = anchor + C.ANCHOR_INJECTED_S
    return anchors.join(orders, key, "left").join(touches, key, "left").select(
        "user_id", "stage",
        second_to_ts("anchor").alias("anchor"),
        second_to_ts("order_sec").alias("order_time"),
        F.coalesce("referred", F.lit(False)).alias("affiliate_referred"),
        F.coalesce(F.col("next_click") <= F.least(F.coalesce("order_sec", horizon), horizon), F.lit(False))
        .alias("injected"),
    )


def incrementality(anchors: DataFrame) -> DataFrame:
    """Order rate by stage for persons with and without a click after the anchor, referred persons left out."""
    return anchors.where(~F.col("affiliate_referred")).groupBy(
        "stage", F.when(F.col("injected"), INJECTED).otherwise(CONTROL).alias("grp")).agg(
        F.count("*").alias("users"), F.count("order_time").alias("orders"),
    ).withColumn("order_rate_pct", pct1(F.col("orders"), F.col("users")))


def incrementality_summary(incrementality: DataFrame) -> DataFrame:
    """Observed orders of the injected persons against those expected from the control rate of their stage."""
    injected, control = F.col("grp") == INJECTED, F.col("grp") == CONTROL
    stages = incrementality.groupBy("stage").agg(
        F.coalesce(F.sum(F.when(injected, F.col("users"))), F.lit(0)).alias("users"),
        F.coalesce(F.sum(F.when(injected, F.col("orders"))), F.lit(0)).alias("orders"),
        ratio(F.sum(F.when(control, F.col("orders"))), F.sum(F.when(control, F.col("users")))).alias("rate"),
    )
    total = stages.agg(
        F.sum("users").alias("injected_users"),
        F.sum("orders").alias("observed_orders"),
        # what to expect is known only if every stage with injected persons has a control rate
        F.when(F.count_if((F.col("users") > 0) & F.col("rate").isNull()) == 0,
               F.sum(F.col("users").cast("double") * F.col("rate"))).alias("expected"),
    )
    observed, expected = F.col("observed_orders"), F.col("expected")
    return total.select(
        "injected_users", "observed_orders",
        round_half(expected, 1).alias("expected_orders_without_click"),
        round_half(ratio(observed, expected), 2).alias("observed_to_expected"),
        round_half(ratio(byar_low(observed), expected), 2).alias("ratio_lo95"),
        round_half(ratio(byar_high(observed), expected), 2).alias("ratio_hi95"),
        round_half(ratio((observed - expected) * 100.0, observed)).alias("pct_orders_incremental"),
    )


def commission_at_risk(summary: DataFrame, sensitivity: DataFrame, us_clicks: DataFrame) -> DataFrame:
    """Commission paid on flagged orders, low and high, per day and year."""
    retail = F.col("brand") == C.RETAIL_BRAND
    shares = sensitivity.where(retail).agg(F.struct(
        F.max(F.when(F.col("look_back") == C.LOOK_BACKS[-1][1], F.col("pct_orders_from_strong"))).alias("lo"),
        F.max(F.when(F.col("look_back") == C.LOOK_BACKS[0][1], F.col("pct_orders_from_strong"))).alias("hi"),
    )).scalar()
    at_checkout = us_clicks.where(retail).agg(ratio(
        count_where(F.col("in_checkout_before") & F.col("converted")), count_where(F.col("converted")))).scalar()

    def money(orders: Column, aov: float, rate: float) -> Column:
        return orders * float(aov) * rate

    def line(scope: str, lo: Column, hi: Column, aov, commission, digits: int) -> Column:
        pay_lo, pay_hi = money(lo, aov[0], commission[0]), money(hi, aov[1], commission[1])
        return F.struct(
            F.lit(scope).alias("scope"),
            round_half(lo).alias("orders_per_day_lo"), round_half(hi).alias("orders_per_day_hi"),
            round_half(pay_lo).alias("commission_per_day_lo"), round_half(pay_hi).alias("commission_per_day_hi"),
            round_half(pay_lo * 365.0 / 1e6, digits).alias("commission_per_year_lo_musd"),
            round_half(pay_hi * 365.0 / 1e6, digits).alias("commission_per_year_hi_musd"),
        )

    orders = F.col("est_us_converted_clicks")
    lo, hi = orders * (F.col("s.lo") / 100.0), orders * (F.col("s.hi") / 100.0)
    injected = orders * F.col("at_checkout")
    retail_lines = summary.where(retail).withColumns({"s": shares, "at_checkout": at_checkout}).select(
        "brand", F.explode(F.array(
            line(C.SCOPE_STRONG, lo, hi, C.RETAIL_AOV, C.RETAIL_COMMISSION, 1),
            line(C.SCOPE_INJECTED, injected, injected, C.RETAIL_AOV,
                 C.RETAIL_COMMISSION, 1),
        )).alias("line"))
    step_lo, step_hi = (F.col(f"est_us_converted_clicks_benchmark_{k}") * C.CLIENT_SHARE_STEP for k in ("lo", "hi"))
    client_line = summary.where(F.col("brand") == C.CLIENT_BRAND).select("brand", line(
        C.SCOPE_CLIENT, step_lo, step_hi, (C.CLIENT_AOV, C.CLIENT_AOV),
        C.CLIENT_COMMISSION, 2).alias("line"))
    return retail_lines.unionByName(client_line).select("brand", "line.*")

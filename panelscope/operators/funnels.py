"""The category journey across sites, and the stage at which affiliate clicks fire."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelscope import config as C
from panelscope.functions.days import PERSON_DAY, lists_by_day, row_of, with_lists
from panelscope.functions.exprs import (
    count_where, event_second, host_in, is_cart_path, is_checkout_path, pct, ratio, registered_domain, round_half,
    url_path,
)
from panelscope.operators.summary import pct1, pct2


def category_events(raw: DataFrame, alias: DataFrame, us_users: DataFrame) -> DataFrame:
    """US persons' events on mattress brands' sites, and mattress articles on review sites (raw, with duplicates)."""
    site = registered_domain("host")
    mattress = F.when(site.isin(*[f"{b}.com" for b in C.MATTRESS_BRANDS]), F.substring_index(site, ".", 1))
    article = F.lower("url").contains("mattress")
    on_brand = F.col("mbrand").isNotNull()
    path = F.col("path")
    kept = (
        raw.select("user_id", "created_time", "host", "url", mattress.alias("mbrand"))
        .where(on_brand | (host_in("host", C.REVIEW_DOMAINS) & article))
    )
    persons = (
        kept.join(alias, "user_id", "left")
        .withColumn("user_id", F.coalesce("person_id", "user_id")).drop("person_id")
        .join(us_users, "user_id", "left_semi")
        .select("user_id", "created_time", "host", "mbrand", article.alias("article"), url_path("url").alias("path"))
    )
    return persons.select(
        "user_id", "created_time", "host", "mbrand",
        (~on_brand & F.col("article")).alias("is_review"),
        (on_brand & path.rlike(C.PRODUCT_PATH_RE)).alias("is_product"),
        (on_brand & is_cart_path(path)).alias("is_cart"),
        (on_brand & is_checkout_path(path)).alias("is_checkout"),
        (on_brand & path.rlike(C.CONVERSION_RE)).alias("is_order"),
    )


def category_funnel(category_events: DataFrame) -> DataFrame:
    """Persons who reached each step of the category journey, in any order."""
    at_cart = F.col("is_cart") | F.col("is_checkout")
    reached = [F.lit(True), F.bool_or("is_review"), F.bool_or(F.col("mbrand").isNotNull()), F.bool_or("is_product"),
               F.bool_or(at_cart), F.bool_or("is_checkout"), F.bool_or("is_order")]
    people = category_events.groupBy("user_id").agg(F.count("*").alias("n"), *[
        r.alias(f"r{i}") for i, r in enumerate(reached[1:], 2)])
    totals = people.agg(F.count("*").alias("r1"), *[
        count_where(F.col(f"r{i}")).alias(f"r{i}") for i in range(2, len(reached) + 1)])
    rows = F.array(*[
        F.struct(F.lit(i).cast("long").alias("step"), F.lit(stage).alias("stage"), F.col(f"r{i}").alias("users"))
        for i, stage in enumerate(C.FUNNEL_STEPS, 1)])
    return totals.select(F.explode(rows).alias("r")).select("r.*")


def brand_funnel_cat(category_events: DataFrame) -> DataFrame:
    """Persons who reached each step, per mattress brand."""
    people = category_events.where(F.col("mbrand").isNotNull()).groupBy("mbrand", "user_id").agg(
        F.bool_or("is_product").alias("product_page"),
        F.bool_or(F.col("is_cart") | F.col("is_checkout")).alias("cart"),
        F.bool_or("is_checkout").alias("checkout"),
        F.bool_or("is_order").alias("ordered"))
    return people.groupBy(F.col("mbrand").alias("brand")).agg(
        F.count("*").alias("visitors"),
        *[count_where(F.col(c)).alias(c) for c in ("product_page", "cart", "checkout", "ordered")])


def cross_shopping(category_events: DataFrame) -> DataFrame:
    """Which other mattress brands the visitors of each focus brand saw.

    A person's brands are a set of at most ``len(MATTRESS_BRANDS)`` names, so the brand
    pairs of a person are read off the set and no self-join is needed.
    """
    seen = category_events.where(F.col("mbrand").isNotNull()).groupBy("user_id").agg(
        F.collect_set("mbrand").alias("seen"))
    focus = F.array_compact(F.array(*[
        F.when(F.array_contains("seen", m), F.struct(F.lit(m).alias("mbrand"), F.lit(b).alias("brand")))
        for m, b in C.CROSS_SHOPPING_FOCUS]))
    visits = seen.select("seen", F.explode(focus).alias("f")).select("f.brand", "f.mbrand", "seen")
    size = F.size("seen")
    shares = visits.groupBy("brand").agg(
        F.count("*").alias("visitors"),
        round_half(ratio(F.sum(size), F.count("*")), 1).alias("avg_brands_seen"),
        round_half(pct(count_where(size > 1), F.count("*"))).alias("pct_saw_another_brand"))
    others = (
        visits.select("brand", F.explode(F.array_except("seen", F.array("mbrand"))).alias("other"))
        .groupBy("brand", "other").agg(F.count("*").alias("n"))
    )
    rank = F.row_number().over(W.partitionBy("brand").orderBy(F.desc("n"), "other"))
    top = others.withColumn("k", rank).where("k <= 5").groupBy("brand").agg(
        F.array_sort(F.collect_list(F.struct("k", F.concat("other", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
                                             .alias("label")))).alias("top"))
    names = F.array_join(F.transform("top", lambda t: t["label"]), ", ")
    return shares.join(top.select("brand", names.alias("top_other_brands")), "brand", "left")


def journey_order(category_events: DataFrame) -> DataFrame:
    """Whether review sites come before or after the first brand site."""
    people = category_events.groupBy("user_id").agg(
        F.min(F.when(F.col("mbrand").isNotNull(), F.col("created_time"))).alias("brand"),
        F.min(F.when(F.col("is_review"), F.col("created_time"))).alias("review"))
    brands_only, reviews_only, review_first, brand_first = C.JOURNEY_PATTERNS
    pattern = (
        F.when(F.col("review").isNull(), brands_only).when(F.col("brand").isNull(), reviews_only)
        .when(F.col("review") < F.col("brand"), review_first).otherwise(brand_first)
    )
    return people.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("users"))


def click_stage(us_clicks: DataFrame, person_days: DataFrame) -> DataFrame:
    """Deepest stage the person had reached on the brand's site in the 30 minutes before the click,
    counting only what happened since their previous click for the brand.

    Pages and clicks share one row per (person, day, brand, second), with the half hour before midnight; the latest second of each
    stage before the click tells whether it falls in the click's own stretch. Only clicks are dealt out.
    """
    keys = ["brand", "user_id", "sec"]
    stages = ("page", "product", "cart", "checkout")
    kind = "; ".join(["brand: string", "sec: bigint", "own: boolean", *[f"{c}: boolean" for c in (*stages, "click")]])
    at = us_clicks.select("brand", "user_id", event_second("click_time").alias("sec")).distinct()
    path, yes = F.col("path"), F.lit(True)
    page = row_of(kind, brand=F.col("brand"), sec=F.col("sec"), own=F.col("own"), page=yes, product=path.rlike(C.PRODUCT_PATH_RE),
                  cart=is_cart_path(path), checkout=is_checkout_path(path))
    seconds = (
        with_lists(person_days, lists_by_day(at, "brand"))
        .withColumn("path", F.when(F.col("is_brand_page"), url_path("url")))
        .select(*PERSON_DAY, F.explode(F.concat(
            F.array_compact(F.array(F.when(F.col("is_brand_page"), page))),
            F.transform("beside", lambda x: row_of(kind, brand=x["brand"], sec=x["sec"], own=x["own"], click=yes)))).alias("r"))
        .select(*PERSON_DAY, "r.*").groupBy(*PERSON_DAY, "brand", "sec", "own").agg(*[F.bool_or(c).alias(c) for c in (*stages, "click")])
    )
    before = W.partitionBy(*PERSON_DAY, "brand").orderBy("sec").rowsBetween(W.unboundedPreceding, -1)
    latest = seconds.select(*keys, "own", "click", *[
        F.max(F.when(F.col(c), F.col("sec"))).over(before).alias(f"last_{c}") for c in (*stages, "click")
    ]).where(F.col("click") & F.col("own"))
    since = F.greatest(F.col("sec") - C.CONTEXT_BEFORE_S, F.coalesce(F.col("last_click") + 1, F.lit(0)))
    at_second = latest.select(*keys, *[
        F.coalesce(F.col(f"last_{c}") >= since, F.lit(False)).alias(c) for c in stages])

    # Of several clicks in one second only the first by key looks back; for the others the
    # stretch since the previous click is empty.
    clicks = us_clicks.select("brand", "click_key", "user_id", event_second("click_time").alias("sec"), "converted",
                              "strong_hijack_signal", "no_landing")
    leads = clicks.groupBy(*keys).agg(F.min("click_key").alias("first_key"))
    joined = clicks.join(at_second.join(leads, keys), keys)
    never, fresh, browsing, product, cart, checkout = C.STAGE_LABELS
    first = F.col("click_key") == F.col("first_key")
    stage = (
        F.when(F.col("no_landing"), never).when(first & F.col("checkout"), checkout)
        .when(first & F.col("cart"), cart).when(first & F.col("product"), product)
        .when(first & F.col("page"), browsing).otherwise(fresh)
    )
    return joined.select("brand", "click_key", "converted", "strong_hijack_signal", stage.alias("stage_at_click"))


def click_funnel_stage(click_stage: DataFrame) -> DataFrame:
    """Clicks and orders per stage, with shares within the brand."""
    counts = click_stage.groupBy("brand", "stage_at_click").agg(
        F.count("*").alias("clicks"), count_where(F.col("converted")).alias("orders"))
    brand = W.partitionBy("brand")
    return counts.withColumns({
        "pct_clicks": pct1(F.col("clicks"), F.sum("clicks").over(brand)),
        "pct_orders": pct1(F.col("orders"), F.sum("orders").over(brand)),
        "conversion_pct": pct2(F.col("orders"), F.col("clicks")),
    }).select("brand", "stage_at_click", "clicks", "pct_clicks", "orders", "pct_orders", "conversion_pct")

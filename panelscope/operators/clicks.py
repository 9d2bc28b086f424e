"""Affiliate clicks: tagged landings and redirect hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelscope import config as C
from panelscope.functions.days import days_of, lists_by_day, row_of, with_lists
from panelscope.functions.exprs import (
    event_second, extract, first_by, first_match, has_affiliate_marker, host_in, param_value, raw_param,
    second_to_ts,
)


def affiliate_landings(events: DataFrame) -> DataFrame:
    """Brand pages whose URL carries an affiliate network's parameters.

    Every parameter is cut out of the URL once; the second step only decodes and chooses.
    """
    url = F.col("url")
    names = (*C.CLICK_ID_PARAMS, "utm_source", "ransiteid", "utm_sharedid", "sharedid", "coupon")
    cut = events.where("is_brand_page").where(has_affiliate_marker(url)).select(
        "brand", "user_id", "session_id", "created_time", "url",
        extract(url, C.RETAIL_PARTNER_RE).alias("_partner"), *[raw_param(url, n).alias(f"_{n}") for n in names])

    def param(name: str):
        return param_value(F.col(f"_{name}"))

    return cut.select(
        "brand", "user_id", "session_id", "created_time", "url",
        F.coalesce(*[param(n) for n in C.CLICK_ID_PARAMS]).alias("network_click_id"),
        first_match(url, C.LANDING_NETWORKS, C.LANDING_NETWORK_DEFAULT).alias("network"),
        F.lower(F.coalesce(F.concat(F.lit("impact:"), "_partner"), param("utm_source"), param("ransiteid"),
                           F.lit("unknown"))).alias("publisher"),
        F.coalesce(param("utm_sharedid"), param("sharedid")).alias("publisher_sub_id"),
        param("coupon").alias("coupon"),
        url.rlike(C.PAID_SEARCH_ID_RE).alias("has_paid_search_click_id"),
    )


def landing_clicks(landings: DataFrame) -> DataFrame:
    """One row per network click id (without one: per user and landing URL).

    Attributes come from the earliest landing row; sub id and coupon from the earliest
    row that has one.
    """
    order = F.struct("created_time", "url", "user_id", "session_id")
    key = F.coalesce("network_click_id", F.concat(F.col("user_id").cast("string"), F.lit("|"), F.col("url")))
    first = F.min(F.struct("created_time", "url", "user_id", "session_id", "network", "publisher"))
    grouped = landings.withColumn("click_key", key).groupBy("brand", "click_key").agg(
        first.alias("f"),
        first_by(F.col("publisher_sub_id"), order).alias("publisher_sub_id"),
        first_by(F.col("coupon"), order).alias("coupon"),
        F.bool_or("has_paid_search_click_id").alias("has_paid_search_click_id"),
        F.count("*").alias("landing_rows"),
        F.count_distinct("session_id").alias("sessions_recorded"),
    )
    return grouped.select(
        "brand", "click_key", F.col("f.created_time").alias("click_time"), "f.user_id", "f.session_id",
        F.col("f.url").alias("landing_url"), "f.network", "f.publisher", "publisher_sub_id", "coupon",
        "has_paid_search_click_id", "landing_rows", "sessions_recorded",
    )


def _hop_network() -> Column:
    network = F
    for label, domains, hosts in C.HOP_NETWORKS:
        network = network.when(host_in("host", domains, hosts), label)
    return network.otherwise(C.HOP_NETWORK_DEFAULT)


def _hop_publisher() -> Column:
    return F.coalesce(*[F.concat(F.lit(label), extract(F.col("url"), pattern)) for label, pattern in C.HOP_PUBLISHERS], F.lit("unknown"))


def affiliate_hops(events: DataFrame) -> DataFrame:
    """Redirect-hop events towards a brand, with network and publisher id."""
    return events.where(F.col("hop_brand").isNotNull()).select(
        F.col("hop_brand").alias("brand"), "user_id", "session_id", "created_time", "host", "url",
        _hop_network().alias("network"), _hop_publisher().alias("publisher"))


def hop_clicks(person_days: DataFrame, landing_clicks: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Hops that are clicks of their own.

    A hop is dropped when a tagged landing of the same person and brand follows within a
    minute, or when it comes 10 seconds or less after the previous hop (one redirect
    chain). Of several hops in one second the first by host and URL stands for all.

    Nothing is looked at more than a minute away, so (person, day) groups with the minutes around midnight are enough. Hops,
    landings and pages are first reduced to one row per (person, day, brand, second): the windows see at most
    86,400 rows per group and a little more, however busy a person is. Only landings are dealt out.

    With ``events`` (by no day yet) the first table holds hops, those of ``affiliate_hops``, and pages are the events'.
    """
    if events is not None:
        both = ["user_id", "created_time", "session_id", "host", "url"]
        pages = events.where("is_brand_page").select(*both, "brand", "is_brand_page", F.lit(None).cast("string").alias("hop_brand"))
        person_days = days_of(pages.unionByName(person_days.select(*both, F.col("brand").alias("hop_brand")), allowMissingColumns=True))
    keys = ["user_id", "day", "brand", "sec"]
    ids = {c: person_days.schema[c].dataType.simpleString() for c in ("session_id",)}
    kind = f"brand: string; sec: bigint; own: boolean; hop: struct<host:string,url:string,session_id:{ids['session_id']},network:string,publisher:string>; landing: boolean; page: boolean"
    yes = F.lit(True)
    hop = F.struct("host", "url", "session_id", _hop_network().alias("network"), _hop_publisher().alias("publisher"))
    at = {"sec": F.col("sec"), "own": F.col("own")}
    landings = landing_clicks.select("user_id", event_second("click_time").alias("sec"), "brand")
    rows = with_lists(person_days, lists_by_day(landings, "brand"), "left").select(
        "user_id", "day", F.explode(F.concat(
            F.array_compact(F.array(
                F.when(F.col("hop_brand").isNotNull(), row_of(kind, brand=F.col("hop_brand"), hop=hop, **at)),
                F.when(F.col("is_brand_page"), row_of(kind, brand=F.col("brand"), page=yes, **at)))),
            F.transform("beside", lambda x: row_of(kind, brand=x["brand"], sec=x["sec"], own=x["own"], landing=yes)))).alias("r"),
    ).select("user_id", "day", "r.*")
    seconds = rows.groupBy(*keys, "own").agg(
        F.min("hop").alias("hop"), F.bool_or("landing").alias("landing"), F.bool_or("page").alias("page"))

    w = W.partitionBy("user_id", "day", "brand").orderBy("sec")
    sec = F.col("sec")
    # Seconds run backwards in the second window, so "next" is again a running aggregate.
    from_here_on = W.partitionBy("user_id", "day", "brand").orderBy(F.desc("sec")).rowsBetween(W.unboundedPreceding, 0)
    marked = seconds.select(
        *keys, "own", "hop",
        F.max(F.when(F.col("hop").isNotNull(), sec)).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("prev_hop"),
        F.min(F.when(F.col("landing"), sec)).over(from_here_on).alias("next_landing"),
        F.min(F.when(F.col("page"), sec)).over(from_here_on).alias("next_page"),
    ).where(F.col("hop").isNotNull() & F.col("own"))

    def within(col: str):
        return F.coalesce(F.col(col) - sec <= C.HOP_LANDING_S, F.lit(False))

    kept = marked.where(~within("next_landing")).where(
        F.col("prev_hop").isNull() | (sec - F.col("prev_hop") > C.HOP_CHAIN_S))
    click_time = second_to_ts(sec)
    nothing = F.lit(None).cast("string")
    return kept.select(
        "brand",
        F.concat_ws("|", F.lit("hop"), F.col("user_id").cast("string"), click_time.cast("string")).alias("click_key"),
        click_time.alias("click_time"),
        "user_id",
        "hop.session_id",
        nothing.alias("landing_url"),
        "hop.network",
        "hop.publisher",
        nothing.alias("publisher_sub_id"),
        nothing.alias("coupon"),
        F.lit(False).alias("has_paid_search_click_id"),
        F.lit(0).cast("long").alias("landing_rows"),
        F.lit(1).cast("long").alias("sessions_recorded"),
        F.when(within("next_page"), C.CLICK_HOP_PAGE).otherwise(C.CLICK_HOP_ONLY).alias("click_source"),
    )


def affiliate_clicks(landing_clicks: DataFrame, hop_clicks: DataFrame) -> DataFrame:
    return landing_clicks.withColumn("click_source", F.lit(C.CLICK_TAGGED)).unionByName(hop_clicks)

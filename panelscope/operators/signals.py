"""What a person did around each affiliate click, and how suspicious that makes the click."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelscope import config as C
from panelscope.functions.days import PERSON_DAY, lists_by_day, row_of, with_lists
from panelscope.functions.exprs import event_second, has_affiliate_marker, host_in, url_param, url_path


# Facts about a person's second on one host, as bits of a number: for each brand a page without a tag, a cart or
# checkout page, a search for it; then a coupon site, and a tagged page.
LANE = 16
PAGE, CHECKOUT, SEARCH, COUPON, TAGGED = 0, LANE, 2 * LANE, 3 * LANE, 3 * LANE + 1


def _age_within(latest: Column, limit: int) -> Column:
    """Seconds since ``latest`` when it lies at most ``limit`` seconds back, else NULL."""
    age = F.col("sec") - latest
    return F.when(age <= limit, age)


def _bit(condition: Column, place: int) -> Column:
    return F.when(condition, F.lit(1 << place).cast("long")).otherwise(F.lit(0).cast("long"))


def _has(facts: Column, place: int) -> Column:
    return facts.bitwiseAND(F.lit(1 << place).cast("long")) != 0


def facts_of_event() -> tuple[dict[str, Column], Column]:
    """Columns that cut up host and URL, and the facts in terms of them."""
    tagged, path = F.coalesce(has_affiliate_marker("url"), F.lit(False)), url_path("url")
    query = F.when(F.col("host").rlike(C.SEARCH_HOST_RE), F.lower(F.coalesce(url_param(F.col("url"), "q"), url_param(F.col("url"), "p"), F.lit(""))))
    told = {"tagged": tagged, "checkout": path.rlike(C.CART_OR_CHECKOUT_RE), "query": query, "coupon": host_in("host", C.COUPON_DOMAINS)}
    bits = [_bit(F.col("coupon"), COUPON), _bit(F.col("tagged"), TAGGED)]
    for i, b in enumerate(C.BRANDS):
        own = F.col("brand") == b.brand
        bits += [_bit(own & F.col("is_brand_page") & ~F.col("tagged"), PAGE + i), _bit(own & F.col("checkout"), CHECKOUT + i),
                 _bit(F.col("query").rlike(b.search_term_re), SEARCH + i)]
    return told, reduce(lambda x, y: x.bitwiseOR(y), bits)


def click_context(clicks: DataFrame, person_days: DataFrame) -> DataFrame:
    """Events of the same person from 30 minutes before each click to 2 minutes after it, as indicators.

    Nothing is joined event by click, and nothing but clicks is dealt out. The seconds and clicks of a (person, day) stand in one
    line, with what lies within reach beyond midnight; running aggregates over it tell each click the latest second
    of each kind of event. An advertiser host with a tagged page at second ``s`` counts for clicks from ``s - 120`` to ``s + 120``:
    its stretches, cut so that they never overlap, are a +1 where they start and a -1 where they have ended, and
    a running sum is the number of distinct hosts. Days without a click are not read on.
    """
    if len(C.BRANDS) > LANE:
        raise ValueError(f"at most {LANE} brands fit the facts")
    at = clicks.select("user_id", event_second("click_time").alias("sec"), F.struct("brand", "click_key").alias("click"))
    click_type = at.schema["click"].dataType
    kind = f"sec: bigint; host: string; brand: string; facts: bigint; click: {click_type.simpleString()}"
    told, facts = facts_of_event()
    lists = lists_by_day(at, "click").withColumn("beside", F.filter("beside", lambda x: x["own"])).where(F.size("beside") > 0)
    line = (
        with_lists(person_days, lists).withColumns(told)
        .select(*PERSON_DAY, F.explode(F.concat(
            F.array(row_of(kind, sec=F.col("sec"), host=F.col("host"), brand=F.col("brand"), facts=facts)),
            F.transform("beside", lambda x: row_of(kind, sec=x["sec"], click=x["click"])))).alias("r"))
        .select(*PERSON_DAY, "r.*").groupBy(*PERSON_DAY, "sec", "host", "click").agg(F.max("brand").alias("brand"), F.bit_or("facts").alias("facts"))
    )

    tagged = _has(F.col("facts"), TAGGED)
    # the next tagged page of the same host: the last one met when walking back
    following = F.last(F.when(tagged, F.col("sec")), ignorenulls=True).over(
        W.partitionBy(*PERSON_DAY, "host").orderBy(F.desc("sec")).rowsBetween(W.unboundedPreceding, -1))
    longest = F.col("sec") + (C.BURST_S + 1)
    stop = F.least(longest, F.coalesce(following - C.BURST_S, longest))
    one = F.lit(1).cast("long")

    def step(sec: Column, host: Column, facts: Column, click: Column, hosts: Column, of: Column) -> Column:
        return F.struct(sec.alias("sec"), host.alias("host"), facts.alias("facts"), click.alias("click"), hosts.alias("hosts"), of.alias("of"))

    text, number, brand = F.lit(None).cast("string"), F.lit(None).cast("long"), F.col("brand")
    no_click = F.lit(None).cast(click_type)
    own = step(F.col("sec"), F.col("host"), F.col("facts"), F.col("click"), number, text)
    edges = F.when(tagged, F.array(
        own, step(F.col("sec") - C.BURST_S, text, number, no_click, one, brand), step(F.col("stop"), text, number, no_click, -one, brand))).otherwise(F.array(own))
    steps = line.withColumn("stop", stop).select(*PERSON_DAY, F.explode(edges).alias("e")).select(*PERSON_DAY, "e.*")

    w = W.partitionBy(*PERSON_DAY).orderBy("sec")
    before, until = w.rangeBetween(W.unboundedPreceding, -1), w.rangeBetween(W.unboundedPreceding, 0)

    def latest(place: int, frame) -> Column:
        return F.max(F.when(_has(F.col("facts"), place), F.col("sec"))).over(frame)

    def of_click(make) -> Column:
        """The value for the click's own brand."""
        out = F
        for i, b in enumerate(C.BRANDS):
            out = out.when(F.col("click.brand") == b.brand, make(i, b.brand))
        return out

    told = steps.select(
        "sec", "click",
        F.max(F.when(F.col("host").isNotNull(), F.struct("sec", "host"))).over(before).alias("active"),
        latest(COUPON, until).alias("last_coupon"), F.sum("hosts").over(until).alias("advertisers"),
        *[latest(lane + i, before).alias(f"{name}{i}") for name, lane in (("page", PAGE), ("checkout", CHECKOUT), ("search", SEARCH)) for i in range(len(C.BRANDS))],
        *[F.sum(F.when(F.col("of") == b.brand, F.col("hosts"))).over(until).alias(f"own{i}") for i, b in enumerate(C.BRANDS)],
    ).where("click IS NOT NULL")

    since_page, since_checkout = (_age_within(of_click(lambda i, _, n=n: F.col(f"{n}{i}")), C.CONTEXT_BEFORE_S) for n in ("page", "checkout"))
    since_active = _age_within(F.col("active.sec"), C.CONTEXT_BEFORE_S)
    searched = _age_within(of_click(lambda i, _: F.col(f"search{i}")), C.SEARCH_BEFORE_S)
    none = F.lit(0).cast("long")
    return told.select(
        "click.brand", "click.click_key",
        since_page.alias("secs_since_brand_page"),
        since_checkout.alias("secs_since_checkout"),
        since_page.isNotNull().alias("already_on_site"),
        since_checkout.isNotNull().alias("in_checkout_before"),
        searched.isNotNull().alias("brand_search_60s"),
        (F.coalesce("advertisers", none) - F.coalesce(of_click(lambda i, _: F.col(f"own{i}")), none)).alias("other_advertisers_2m"),
        _age_within(F.col("last_coupon"), C.COUPON_BEFORE_S).isNotNull().alias("coupon_ext_60s"),
        since_active.isNull().alias("no_referrer"),
        F.when(since_active.isNotNull(), F.col("active.host")).alias("prev_host"),
        since_active.alias("secs_since_prev"),
    )


def click_risk(clicks: DataFrame, context: DataFrame) -> DataFrame:
    """Clicks with their indicators, the first-ranked signal, and the click-flooding flag.

    Clicks per person and day are counted with a group-by and joined back; a count over a window
    would send all clicks of the busiest person to one task.
    """
    day = F.to_date("click_time").alias("click_day")
    volume = clicks.groupBy("brand", "user_id", day).agg(F.count("*").alias("user_brand_clicks"))
    joined = (
        clicks.join(context, ["brand", "click_key"]).withColumn("click_day", day)
        .join(volume, ["brand", "user_id", "click_day"]).drop("click_day")
    )
    no_landing = F.col("click_source") == C.CLICK_HOP_ONLY
    burst = F.col("other_advertisers_2m") >= C.BURST_MIN_HOSTS
    tiers = (no_landing, F.col("in_checkout_before"), F.col("already_on_site"), F.col("has_paid_search_click_id"),
             F.col("brand_search_60s"), F.col("coupon_ext_60s"), burst, F.col("no_referrer"))
    signal = F
    for cond, label in zip(tiers, C.SIGNAL_LABELS):
        signal = signal.when(cond, label)
    return joined.withColumns({
        "no_landing": no_landing,
        "multi_brand_burst": burst,
        "primary_signal": signal.otherwise(C.SIGNAL_LABELS[-1]),
        "strong_hijack_signal": tiers[0] | tiers[1] | tiers[2] | tiers[3],
        "click_flood": F.col("user_brand_clicks") >= C.FLOOD_MIN_CLICKS,
    })

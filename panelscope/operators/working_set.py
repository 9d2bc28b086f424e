"""From raw events to the working set: tag brands, keep their users, remove duplicates, merge mirrored ids."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelscope import config as C
from panelscope.functions.days import by_day
from panelscope.functions.exprs import brand_of_domain, decoded_or_raw, event_second, extract, host_in, registered_domain
from panelscope.functions.joins import keep_members

_DOMAINS = tuple(b.domain for b in C.BRANDS)
_HOP_TARGET_RE = r"\b(" + "|".join(re.escape(d) for d in _DOMAINS) + r")\b"
_TOKEN = ["created_time", "url"]

# Ids of an event that meet its first ids in one group.
PAIR_BLOCK = 500
# Ids of an event that are met in the first, second and third round of the search for mirrored ids.
HEADS = 4
NEAR = 64
FAR = 4096


def brands(spark: SparkSession) -> DataFrame:
    """The brand dimension; as many rows as ``config.BRANDS`` has entries."""
    return spark.createDataFrame(
        [(b.brand, b.domain, b.is_client, b.search_term_re) for b in C.BRANDS],
        "brand string, domain string, is_client boolean, search_term_re string",
    )


def brand_tagging(raw: DataFrame) -> DataFrame:
    """Add the brand domain of the host, and the brand domain an affiliate hop leads to.

    The URL is decoded only on the few redirect hosts.
    """
    host, site = F.col("host"), registered_domain("host")
    destination = F.lower(F.concat(host, F.lit(" "), decoded_or_raw(F.col("url"))))
    return raw.withColumns({
        "brand_domain": F.when(site.isin(*_DOMAINS), site),
        "hop_brand_domain": F.when(host_in(host, C.HOP_DOMAINS, C.HOP_HOSTS), extract(destination, _HOP_TARGET_RE)),
    })


def brand_users(tagged: DataFrame) -> DataFrame:
    """Users with at least one event on a brand's site or on a hop towards a brand."""
    touched = F.col("brand_domain").isNotNull() | F.col("hop_brand_domain").isNotNull()
    return tagged.where(touched).select("user_id").distinct()


def brand_user_events_raw(tagged: DataFrame, users: DataFrame) -> DataFrame:
    """All events of the brand users, one per (user, second, URL): the one with the lowest event id.

    With a small list of brand users only their events are shuffled. The lowest row is an
    aggregate rather than a rank, so copies of one event collapse before the shuffle.
    """
    rest = ["event_id", "session_id", "host", "brand_domain", "hop_brand_domain"]
    lowest = (
        keep_members(tagged, users, "user_id")
        .groupBy("user_id", *_TOKEN).agg(F.min(F.struct(*rest)).alias("e"))
    )
    return lowest.select("e.event_id", "user_id", "e.session_id", "created_time", "e.host", "url",
                         "e.brand_domain", "e.hop_brand_domain")


def shared_events(events: DataFrame) -> DataFrame:
    """Events that may tie two user ids together: same second and URL under two or more ids.

    ``seen_by`` is the number of ids with the event and ``head`` the smallest of them. Ids
    with fewer than three such events cannot be linked to anyone and are left out. What
    remains is a small part of the working set, and every branch of the linking reads it.
    """
    tokens = (
        events.groupBy(*_TOKEN).agg(F.count("*").alias("seen_by"), F.min("user_id").alias("head"))
        .where("seen_by > 1")
    )
    shared = events.select("user_id", *_TOKEN).join(tokens, _TOKEN)
    eligible = shared.groupBy("user_id").agg(F.count("*").alias("n")).where(
        F.col("n") >= C.MIRROR_MIN_SHARED).select("user_id")
    return shared.join(eligible, "user_id", "left_semi")


def _searched(shared: DataFrame, wanted: DataFrame, first: int | None, rare_only: bool) -> DataFrame:
    """One round of the search for the smallest partner of the ids ``wanted`` (user_id, best, tried).

    Only the ``first`` smallest ids of each event are met (all, if not given), so a round costs at most so many candidates per
    id and event. Up to the last id met in the fullest of its events (``tried``), an id has seen all shared events of all
    candidates: a partner up to there is the smallest, and a later one only the ``best`` so far. An id is ``open`` while smaller
    partners than the best may follow. With ``rare_only`` an id meets candidates in all but its two most frequent events, where
    every partner must show up, and looks up in those two only whom it has met.
    """
    need = C.MIRROR_MIN_SHARED
    mine = shared.join(wanted, "user_id")
    if rare_only:
        mine = mine.withColumn("nth", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("seen_by"), *_TOKEN)))
        top, mine = mine.where(F.col("nth") < need), mine.where(F.col("nth") >= need)
    met = shared.select(F.col("user_id").alias("a"), *_TOKEN, "seen_by")
    if first is not None:
        met = met.withColumn("k", F.row_number().over(W.partitionBy(*_TOKEN).orderBy("a"))).where(F.col("k") <= first)
    # a frequent event is met block by block: each block of the ids that search it meets its first ids in a group of its own
    blocks = F.ceil(F.col("seen_by") / PAIR_BLOCK)
    met = met.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).drop("seen_by")
    mine = mine.withColumn("block", F.pmod(F.xxhash64("user_id"), blocks))
    limit = F.coalesce("best", "user_id")
    pairs = (
        mine.join(met, [*_TOKEN, "block"]).where((F.col("a") < limit) & (F.col("tried").isNull() | (F.col("a") > F.col("tried"))))
        .groupBy("user_id", "a").agg(F.count("*").alias("n"))
    )
    if rare_only:
        rest = (
            pairs.where(F.col("n") < need).join(top.select("user_id", *_TOKEN), "user_id")
            .join(shared.select(F.col("user_id").alias("a"), *_TOKEN), ["a", *_TOKEN]).groupBy("user_id", "a").agg(F.count("*").alias("more"))
        )
        pairs = pairs.join(rest, ["user_id", "a"], "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0)))
    found = pairs.where(F.col("n") >= need).groupBy("user_id").agg(F.min("a").alias("found"))
    out = wanted.select("user_id", "best").join(found, "user_id", "left").withColumn("best", F.coalesce("found", "best"))
    if first is None:
        return out.select("user_id", "best", F.lit(None).cast(out.schema["user_id"].dataType).alias("tried"), F.lit(False).alias("open"))
    last = shared.where(F.col("seen_by") > first).select("user_id", *_TOKEN).withColumn(
        "k", F.row_number().over(W.partitionBy(*_TOKEN).orderBy("user_id"))).where(F.col("k") == first).select(*_TOKEN, F.col("user_id").alias("last"))
    tried = mine.join(last, _TOKEN).groupBy("user_id").agg(F.min("last").alias("tried"))
    return out.join(tried, "user_id", "left").select(
        "user_id", "best", "tried", F.coalesce(F.col("tried") < F.coalesce("best", "user_id"), F.lit(False)).alias("open"))


def _everyone(shared: DataFrame) -> DataFrame:
    kind = shared.schema["user_id"].dataType
    return shared.select("user_id").distinct().select("user_id", F.lit(None).cast(kind).alias("best"), F.lit(None).cast(kind).alias("tried"))


def alias_heads(shared: DataFrame) -> DataFrame:
    """First round: the very smallest ids of each event. Where many ids share all their events, all find the smallest here."""
    return _searched(shared, _everyone(shared), HEADS, rare_only=False)


def alias_near(shared: DataFrame, alias_heads: DataFrame | None = None) -> DataFrame:
    """Second round: more of the smallest ids of each event, for the ids still open; without a first round, for all ids.

    Ids whose events are all small are done, with or without a partner. Those of the first round that were done are given, too.
    """
    if alias_heads is None:
        return _searched(shared, _everyone(shared), NEAR, rare_only=False)
    rest = _searched(shared, alias_heads.where("open").drop("open"), NEAR, rare_only=False)
    return alias_heads.where("NOT open").unionByName(rest)


def alias_far(shared: DataFrame, alias_near: DataFrame) -> DataFrame:
    """Third round, for the ids still open: many more ids of each event, but none of their own two most frequent events."""
    return _searched(shared, alias_near.where("open").drop("open"), FAR, rare_only=True)


def user_alias(shared: DataFrame, alias_near: DataFrame, alias_far: DataFrame) -> DataFrame:
    """Mirrored ids: ``user_id`` -> ``person_id``, the smallest id it shares three or more events with.

    One step only: the person id may itself be an alias of a third id. Candidates are met in ascending order, in rounds (see
    ``_searched``), and an id leaves the search with its smallest partner. The last round meets all that is left.
    """
    rest = _searched(shared, alias_far.where("open").drop("open"), None, rare_only=True)
    done = alias_near.where("NOT open").unionByName(alias_far.where("NOT open")).unionByName(rest)
    return done.where(F.col("best").isNotNull()).select("user_id", F.col("best").alias("person_id"))


def brand_user_events(events: DataFrame, alias: DataFrame) -> DataFrame:
    """Events per person (``user_id`` is the person from here on), one per (person, second, URL)."""
    rest = ["event_id", "raw_user_id", "session_id", "host", "brand_domain", "hop_brand_domain"]
    lowest = (
        events.join(alias, "user_id", "left")
        .withColumns({"raw_user_id": F.col("user_id"), "person": F.coalesce("person_id", "user_id")})
        .groupBy("person", *_TOKEN).agg(F.min(F.struct(*rest)).alias("e"))
    )
    host, domain = F.col("e.host"), F.col("e.brand_domain")
    main_site = (host == domain) | (host == F.concat(F.lit("www."), domain))
    return lowest.select(
        "e.event_id",
        F.col("person").alias("user_id"),
        "e.raw_user_id",
        "e.session_id",
        "created_time",
        "e.host",
        "url",
        brand_of_domain(domain).alias("brand"),
        F.coalesce(main_site, F.lit(False)).alias("is_brand_page"),
        brand_of_domain(F.col("e.hop_brand_domain")).alias("hop_brand"),
    )


def person_days(events: DataFrame) -> DataFrame:
    """The working set by (person, day), with the rows around midnight that a day looks at: what windows over events read.

    Stored in buckets of (person, day), so its readers deal no events out again.
    """
    return by_day(events.select(
        "user_id", event_second("created_time").alias("sec"), "session_id", "host", "url", "brand", "is_brand_page", "hop_brand"))

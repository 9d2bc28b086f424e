"""A browsing clickstream derived from the ``events`` table.

Every ``events`` row turns into zero or more page events by fixed integer rules
(see FIXTURES.md, section 2), so the clickstream grows with the table and the same
rows can be written in SQL. One narrow pass: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope import config as C
from panelscope.functions.exprs import event_second, second_to_ts

DAY_START = 1777593600      # 2026-05-01 00:00:00 in seconds since 1970
EVENTS_START = 1704067200   # 2024-01-01 00:00:00
SQUEEZE = 30                # thirty days of events fit into one day

TERMS = ("saatva", "nectar", "helix", "dreamcloud", "walmart")
DUPLICATE_ID = 10 ** 12
MIRROR_ID = 2 * 10 ** 12
MIRROR_USER = 10 ** 6


def _pick(index: Column, values) -> Column:
    out = F
    for i, value in enumerate(values):
        out = out.when(index == i, F.lit(value))
    return out


def _s(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def clickstream_from_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    base = events.select(
        F.col("event_id"), F.col("user_id"), F.col("event_type").alias("kind"), k.alias("k"),
        F.floor((event_second("ts") - EVENTS_START) / SQUEEZE).alias("sec"),
        ((F.col("user_id") + F.when(k % 7 == 0, 1).otherwise(0)) % 5).alias("bi"),
    )
    k, kind, uid, eid, bi = (F.col(c) for c in ("k", "kind", "user_id", "event_id", "bi"))
    domain = _pick(bi, [b.domain for b in C.BRANDS])
    term = _pick(bi, TERMS)
    site = _s("https://www.", domain)
    retail = bi == 4

    def landing(click_id: Column) -> Column:
        tagged = (
            F.when(retail, _s("https://www.walmart.com/ip/", k, "?veh=aff&wmlspartner=imp_", 100 + k % 8,
                              "&clickid=c", click_id))
            .when(bi == 0, _s("https://www.saatva.com/mattresses/m", k % 9, "?click_id=1100l", click_id,
                              "&utm_medium=affiliate&utm_source=Pub", k % 8))
            .otherwise(_s(site, "/products/p", k % 9, "?CIDIMP=i", click_id,
                          "&irgwc=1&utm_medium=AFF&utm_source=Pub", k % 8))
        )
        return F.concat(
            tagged,
            F.when(k % 6 == 0, _s("&coupon=SAVE%20", k % 4)).otherwise(""),
            F.when(k % 11 == 0, "&gad_source=1").otherwise(""),
        )

    view, click, error = kind == "view", kind == "click", kind == "error"
    signup, purchase = kind == "signup", kind == "purchase"
    abroad = uid % 9 == 0
    blog = F.when(k % 3 == 0, "slickdeals.net").otherwise(_s("blog", k % 10, ".example.com"))
    hop_host = F.when(retail, "goto.walmart.com").otherwise(_s(term, ".prf.hn"))
    news = _s("news", k % 10, ".co.uk")

    def hop_url(path: str, step: str, item: str) -> Column:
        return (
            F.when(retail, _s("https://goto.walmart.com/c/", k, f"/{path}?u=https%3A%2F%2Fwww.walmart.com%2Fip%2F{item}"))
            .otherwise(_s("https://", term, ".prf.hn/click/camref:1011", k, f"{step}/destination:https%3A%2F%2F",
                          domain, "%2F"))
        )

    rules = [
        (0, view & (k % 4 != 2), 0, domain,
         F.when(k % 4 == 0, _s(site, "/products/p", k % 9)).when(k % 4 == 1, _s(site, "/"))
          .otherwise(_s(site, "/?gclid=g", eid, "&utm_medium=cpc"))),
        (1, view & (k % 4 == 2), 0, F.lit("sleepopolis.com"), _s("https://sleepopolis.com/best-mattress/", k)),
        (2, click & (k % 13 != 0), -20, blog, _s("https://", blog, "/post/", k)),
        (3, click & (k % 5 == 0), -2, hop_host, hop_url("x", "", "1")),
        (4, click & (k % 10 != 0), 0, domain, landing(eid)),
        (5, click & (k % 4 == 1), 3, domain, landing(eid)),
        *[(6 + j, click & (uid % 30).isin(4, 7) & (k % 10 != 0), 5 + 5 * j, domain, landing(_s(eid, f"0{j}")))
          for j in (0, 1)],
        (8, signup & (k % 5 != 0), 0, domain, _s(site, "/account/create")),
        (9, signup & (k % 5 == 0), 0, F.lit("affirm.com"),
         _s("https://www.affirm.com/apply?merchant=", _pick(bi, [b.name for b in C.BRANDS]))),
        (10, purchase, -90, domain, _s(site, "/cart")),
        (11, purchase & (k % 6 == 1), -60, domain, landing(eid)),
        (12, purchase & (k % 4 != 0), -40, domain, _s(site, "/checkout")),
        (13, purchase & (k % 3 < 2), 0, domain,
         F.when(retail, _s(site, "/thankyou?o=", eid)).otherwise(_s(site, "/checkouts/x/thank-you?o=", eid))),
        (14, error, 0,
         F.when(abroad, news).when(k % 3 == 0, "google.com").when(k % 3 == 1, "capitaloneshopping.com")
          .otherwise("msn.com"),
         F.when(abroad, _s("https://news.co.uk/", k))
          .when(k % 3 == 0, _s("https://www.google.com/search?q=", term, "%20deal"))
          .when(k % 3 == 1, _s("https://capitaloneshopping.com/c/", k)).otherwise(_s("https://msn.com/", k))),
        (15, click & (k % 17 == 2), -15, domain, _s(site, "/")),
        *[(16 + j, (error | view) & abroad, 7 + 7 * j, news, _s("https://news.co.uk/", k, f"/{j}"))
          for j in (0, 1, 2)],
        (19, click & (k % 20 == 10), 1, domain, _s(site, "/")),
        (20, click & (k % 15 == 0), 1, hop_host, hop_url("y", "/hop2", "2")),
        (21, click & (k % 9 == 4), -30, F.lit("google.com"), _s("https://www.google.com/search?q=best%20", term)),
        *[(22 + j, click & (k % 12 == 5), 40 + j, _pick((bi + 1 + j) % 5, [b.domain for b in C.BRANDS]),
           _s("https://www.", _pick((bi + 1 + j) % 5, [b.domain for b in C.BRANDS]), "/products/p", k % 9,
              "?irclickid=b", eid, f"{j}&utm_source=Pub9"))
          for j in (0, 1)],
    ]
    pages = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(n).cast("long").alias("n"), F.lit(off).cast("long").alias("off"),
                              host.alias("host"), url.alias("url")))
        for n, cond, off, host, url in rules
    ]))
    copies = F.array_compact(F.array(
        F.struct(F.lit(0).cast("long").alias("id_shift"), F.lit(False).alias("mirror")),
        *[F.when(cond, F.struct(F.lit(shift).cast("long").alias("id_shift"), F.lit(mirror).alias("mirror")))
          for cond, shift, mirror in (
              (k % 7 == 3, DUPLICATE_ID, False),
              ((uid % 10 == 9) & (k % 2 == 0), MIRROR_ID, True),
              ((uid % 10 == 9) & (k % 2 == 0) & (k % 7 == 3), DUPLICATE_ID + MIRROR_ID, True))],
    ))
    return (
        base.select("event_id", "user_id", "sec", F.explode(pages).alias("p"), copies.alias("copies"))
        .select("event_id", "user_id", "sec", "p", F.explode("copies").alias("c"))
        .select(
            (F.col("event_id") * 64 + F.col("p.n") + F.col("c.id_shift")).alias("event_id"),
            (F.col("user_id") + F.when(F.col("c.mirror"), MIRROR_USER).otherwise(0)).cast("long").alias("user_id"),
            (F.col("user_id") * 10 + F.col("p.n") % 2 + F.when(F.col("c.mirror"), 5).otherwise(0))
            .cast("long").alias("session_id"),
            second_to_ts(F.greatest(F.col("sec") + F.col("p.off"), F.lit(0)) + DAY_START).alias("created_time"),
            F.col("p.host").alias("host"),
            F.col("p.url").alias("url"),
        )
    )


def read_clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clickstream of an ``events`` table, dealt out by event as a delivered export is over its files."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    return clickstream_from_events(events.repartition("event_id"))

"""Hand-written clickstreams at the edges of the definitions, and published arithmetic."""

import datetime as dt

import pytest

from panelscope.operators import clicks, conversions, incrementality, seasonality, visits, working_set
from panelscope.plans.store import TableStore
from panelscope.sources.trends import TRENDS_SCHEMA

DAY = dt.datetime(2026, 5, 1, 12)
RAW = "event_id string, user_id string, session_id string, created_time timestamp_ntz, host string, url string"
HOME = ("saatva.com", "https://www.saatva.com/")
HOP = ("saatva.prf.hn", "https://saatva.prf.hn/click/camref:1011ab/destination:https%3A%2F%2Fwww.saatva.com%2F")


def landing(i):
    return "saatva.com", f"https://www.saatva.com/p?click_id=1100l{i}&utm_source=Pub"


def events(spark, *rows):
    """Rows of (second, host, url[, user])."""
    data = [(f"e{i:03d}", r[3] if len(r) > 3 else "u", "s", DAY + dt.timedelta(seconds=r[0]), r[1], r[2])
            for i, r in enumerate(rows)]
    raw = spark.createDataFrame(data, RAW)
    tagged = working_set.brand_tagging(raw)
    kept = working_set.brand_user_events_raw(tagged, working_set.brand_users(tagged))
    no_alias = spark.createDataFrame([], "user_id string, person_id string")
    return TableStore(spark).write("events", working_set.brand_user_events(kept, no_alias))


def all_clicks(ev):
    lc = TableStore(ev.sparkSession).write("landing_clicks", clicks.landing_clicks(clicks.affiliate_landings(ev)))
    return clicks.affiliate_clicks(lc, clicks.hop_clicks(clicks.affiliate_hops(ev), lc, ev))


@pytest.mark.parametrize("gap, expected", [(1800, 1), (1801, 2)])
def test_visit_gap(spark, gap, expected):
    assert visits.brand_visits(events(spark, (0, *HOME), (gap, *HOME))).count() == expected


@pytest.mark.parametrize("delay, expected", [(60, ["tagged landing"]), (61, ["hop, no landing", "tagged landing"])])
def test_hop_followed_by_landing(spark, delay, expected):
    got = all_clicks(events(spark, (0, *HOP), (delay, *landing(1))))
    assert sorted(r["click_source"] for r in got.collect()) == expected


@pytest.mark.parametrize("gap, expected", [(10, 1), (11, 2)])
def test_redirect_chain(spark, gap, expected):
    second = (HOP[0], HOP[1].replace("1011ab", "1011cd"))
    got = all_clicks(events(spark, (0, *HOP), (gap, *second), (gap, *HOME)))
    assert got.count() == expected
    assert {r["click_source"] for r in got.collect()} == {"hop + untagged landing"}


def test_order_at_the_next_click_belongs_to_the_next_click(spark):
    ev = events(spark, (0, *landing(1)), (100, *landing(2)), (100, "saatva.com", "https://www.saatva.com/thank-you"))
    ac = all_clicks(ev)
    orders = conversions.conversions(conversions.conversion_events(ev))
    got = conversions.click_outcomes(ac, orders, conversions.funnel_events(ev))
    assert {r["click_key"]: r["converted"] for r in got.collect()} == {"1100l1": False, "1100l2": True}


def test_coupon_of_the_first_row_that_has_one(spark):
    host, url = landing(7)
    ev = events(spark, (0, host, url), (5, host, url + "&coupon=B%20C"), (9, host, url + "&coupon=A"))
    row = clicks.landing_clicks(clicks.affiliate_landings(ev)).first()
    assert (row["coupon"], row["landing_rows"], row["landing_url"]) == ("B C", 3, url)


def test_hop_to_another_country_site_is_no_click(spark):
    # (goto.walmart.com itself names the brand in its host, so another redirect host is needed here)
    ca = ("x.sjv.io", "https://x.sjv.io/c/1/x?u=https%3A%2F%2Fwww.walmart.ca%2Fip%2F1")
    ev = events(spark, (0, *ca), (5, *HOME))
    assert clicks.affiliate_hops(ev).count() == 0


def test_only_the_path_marks_an_order(spark):
    ev = events(spark, (0, "saatva.com", "https://www.saatva.com/?next=/thankyou"),
                (9, "checkout.saatva.com", "https://checkout.saatva.com/checkouts/1/thank-you"))
    assert [r["host"] for r in conversions.conversion_events(ev).collect()] == ["checkout.saatva.com"]


def test_orders_count_gaps_from_the_row_before(spark):
    page = ("saatva.com", "https://www.saatva.com/thankyou")
    ev = events(spark, (0, *page), (1500, *page), (3000, *page), (4801, *page))
    got = conversions.conversions(conversions.conversion_events(ev))
    assert sorted((r["conversion_time"] - DAY).seconds for r in got.collect()) == [0, 4801]


ANCHORS = "user_id string, stage string, order_time timestamp_ntz, affiliate_referred boolean, injected boolean"


def test_no_control_gives_null(spark):
    got = incrementality.incrementality_summary(incrementality.incrementality(
        spark.createDataFrame([("u", "cart", DAY, False, True)], ANCHORS))).first()
    assert got["observed_orders"] == 1 and got["expected_orders_without_click"] is None


def test_published_incrementality(spark):
    rows = []
    for stage, injected, users, orders in (("cart", True, 38, 13), ("cart", False, 1280, 406),
                                           ("checkout", True, 18, 12), ("checkout", False, 759, 575)):
        rows += [(f"{i}", stage, DAY if i < orders else None, False, injected) for i in range(users)]
    got = incrementality.incrementality_summary(
        incrementality.incrementality(spark.createDataFrame(rows, ANCHORS))).first().asDict()
    assert got == {
        "injected_users": 56, "observed_orders": 25, "expected_orders_without_click": 25.7, "observed_to_expected": 0.97,
        "ratio_lo95": 0.63, "ratio_hi95": 1.44, "pct_orders_incremental": -3.0}


def test_seasonal_ratio(spark):
    days = [(dt.date(2026, 4, 27), 99), (dt.date(2026, 4, 28), 30), (dt.date(2026, 5, 4), 50), (dt.date(2026, 5, 5), 99),
            (dt.date(2026, 8, 1), 10), (dt.date(2026, 8, 31), 30)]
    df = spark.createDataFrame([(d, v, v, v, v, 0) for d, v in days], TRENDS_SCHEMA)
    got = {r["brand"]: r["ratio"] for r in seasonality.seasonal_ratio(df).collect()}
    assert got["Saatva"] == 2.0 and "Walmart" not in got  # no interest in the month, no ratio

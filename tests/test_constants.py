"""Fixed values, written out here a second time: what each pattern takes and leaves, and the numbers of the rules."""

import re

import pytest

from panelscope import config as C

PATTERNS = [
    (C.AFFILIATE_MARKER_RE, ["?irclickid=1", "&CIDIMP=x", "?irgwc=1", "?click_id=1100lx", "&cjevent=", "?ranMID=", "?awc=", "?sscid=", "?avad=", "?veh=aff", "?wmlspartner=imp_5", "?utm_medium=affiliate", "?utm_medium=aff#x", "&utm_medium=affiliates&a"],
     ["?irgwc=0", "?click_id=abc", "?utm_medium=affinity", "xawc=1", "?wmlspartner=5", "?veh=mkt"]),
    (C.CONVERSION_RE, ["/thank-you", "/thankyou/", "/Thank_You?o=1", "/checkout/onepage/success", "/checkout/confirmation#a", "/order-confirmation", "/ordercomplete", "/purchase/confirmation"],
     ["/thank-yous", "/checkout/successful", "/checkout", "/orders"]),
    (C.CART_RE, ["/cart", "/Basket/", "/a/cart/b"], ["/cartoon", "/mycart-1"]),
    (C.CHECKOUT_PAGE_RE, ["/checkout", "/checkouts/x"], ["/checkoutx"]),
    (C.CART_OR_CHECKOUT_RE, ["/cart?x", "/checkouts#y", "/basket"], ["/carts", "/recheckout-1"]),
    (C.REGISTRATION_RE, ["/account/create", "/register/", "/signup", "/sign-up", "/createaccount", "/account/signup"], ["/account", "/registered", "/signups"]),
    (C.PRODUCT_PATH_RE, ["/ip/5", "/products/a", "/product/a", "/mattresses/x", "/mattress-bundles/x", "/pillows/y"], ["/IP/5", "/products", "/products/", "/a/products/b"]),
    (C.SEARCH_HOST_RE, ["google.com", "www.google.co.uk", "bing.com", "search.yahoo.com", "duckduckgo.com", "search.brave.com", "ecosia.org", "search.aol.com", "startpage.com"],
     ["notgoogle.com", "yahoo.com", "brave.com", "bing.com.evil"]),
    (C.PAID_SEARCH_ID_RE, ["?gclid=1", "&gad_source=1", "?gbraid=", "?wbraid=", "?msclkid="], ["?gclsrc=", "xgclid="]),
    (C.RETAIL_PARTNER_RE, ["?wmlspartner=imp_12"], ["?wmlspartner=imp_x"]),
    (C.URL_PATH_RE, ["https://a.com/x"], ["HTTPS://a.com/x", "a.com/x"]),
    (C.URL_SECTION_RE, ["https://a.com/x/y"], ["https://a.com"]),
]


@pytest.mark.parametrize(("pattern", "taken", "left"), PATTERNS)
def test_patterns(pattern, taken, left):
    found = re.compile(pattern)
    assert [t for t in taken if not found.search(t)] == []
    assert [t for t in left if found.search(t)] == []


def first_label(rules, url, default):
    return next((label for label, pattern in rules if re.search(pattern, url)), default)


@pytest.mark.parametrize(("url", "label"), [
    ("?irclickid=1&cjevent=2", "Impact"), ("?wmlspartner=imp_1", "Impact"), ("?clickref=1", "Partnerize"), ("?click_id=1100l5", "Partnerize"), ("?cjdata=1", "CJ"),
    ("?ranSiteID=1", "Rakuten"), ("?awc=1", "Awin"), ("?sscid=1", "ShareASale"), ("?avad=1", "AvantLink"), ("?utm_medium=aff", "UTM only")])
def test_networks_of_landings(url, label):
    assert first_label(C.LANDING_NETWORKS, url, C.LANDING_NETWORK_DEFAULT) == label


@pytest.mark.parametrize(("url", "label"), [
    ("?gclid=1&utm_medium=email", "Paid search"), ("?utm_medium=cpc", "Paid search"), ("?utm_medium=paid_search", "Paid search"), ("?fbclid=1", "Social (paid/organic)"),
    ("?utm_source=tiktok", "Social (paid/organic)"), ("?utm_medium=e-mail", "Email / SMS"), ("?utm_medium=ctv", "Display / TV"), ("?utm_campaign=x", "Other tagged"),
    ("/", "Untagged (organic / direct / referral)")])
def test_sources_of_visits(url, label):
    assert first_label(C.ENTRY_SOURCES, url, C.ENTRY_SOURCE_DEFAULT) == label


def test_lists():
    assert [(b.brand, b.domain, b.is_client) for b in C.BRANDS] == [
        ("Saatva", "saatva.com", True), ("Nectar", "nectarsleep.com", False), ("Helix", "helixsleep.com", False),
        ("DreamCloud", "dreamcloudsleep.com", False), ("Walmart", "walmart.com", False)]
    assert (len(C.HOP_DOMAINS), len(C.HOP_HOSTS)) == (22, 5)
    assert {d for _, domains, hosts in C.HOP_NETWORKS for d in (*domains, *hosts)} == {*C.HOP_DOMAINS, *C.HOP_HOSTS}
    assert (len(set(C.COUPON_DOMAINS)), len(set(C.REVIEW_DOMAINS)), len(set(C.MATTRESS_BRANDS)), len(set(C.NON_US_CCTLDS)), len(set(C.FINANCING_DOMAINS))) == (18, 13, 23, 53, 8)
    assert {"joinhoney.com", "slickdeals.net", "savings.com"} <= set(C.COUPON_DOMAINS) and not {"co", "io", "ai", "us", "eu", "tv", "me"} & set(C.NON_US_CCTLDS)
    assert C.CLICK_ID_PARAMS == ("irclickid", "cidimp", "clickid", "click_id", "app_clickref", "clickref", "cjevent", "awc", "sscid", "avad")
    assert [len(x) for x in (C.SIGNAL_LABELS, C.STAGE_LABELS, C.FUNNEL_STEPS, C.COVERAGE_SITES, C.ACTIVITY_TIERS)] == [9, 6, 7, 22, 5]
    assert [label[0] for label in C.SIGNAL_LABELS] == list("012345678")


def test_numbers():
    assert (C.VISIT_GAP_S, C.HOP_LANDING_S, C.HOP_CHAIN_S, C.CONTEXT_BEFORE_S, C.CONTEXT_AFTER_S, C.SEARCH_BEFORE_S, C.COUPON_BEFORE_S, C.BURST_S) == (1800, 60, 10, 1800, 120, 60, 60, 120)
    assert (C.BURST_MIN_HOSTS, C.FLOOD_MIN_CLICKS, C.FLOOD_THRESHOLDS, C.MIRROR_MIN_SHARED, C.NON_US_PCT, C.MIN_REPORT_CLICKS, C.MIN_ORDERS_FOR_RATE) == (2, 20, (10, 20, 50), 3, 20, 5, 10)
    assert (C.ANCHOR_ORDER_S, C.ANCHOR_REFERRED_S, C.ANCHOR_INJECTED_S) == (7200, 1800, 3600)
    assert (C.US_INTERNET_USERS, C.BENCHMARK_CR_LOW, C.BENCHMARK_CR_HIGH, C.BENCHMARK_DAYS) == (324e6, 0.005, 0.02, 31)
    assert (C.RETAIL_AOV, C.RETAIL_COMMISSION, C.CLIENT_AOV, C.CLIENT_COMMISSION, C.CLIENT_SHARE_STEP) == ((100, 125), (0.01, 0.04), 860, (0.03, 0.10), 0.1)
    assert (C.SEASON_WEEK, C.SEASON_MONTH, C.MAY_CALIBRATION) == (("2026-04-28", "2026-05-04"), 8, ("Saatva", "Nectar", "DreamCloud"))
    assert (C.JOURNEY_STEPS_BEFORE, C.JOURNEY_STEPS_AFTER, C.MIN_SITE_USERS, C.EXTREME_EVENTS) == (6, 2, 20, 5000)
    assert [s for s, _ in C.LOOK_BACKS] == [1800, 600, 120]

"""Parameters of the analysis: brands, site lists, thresholds and economics.

Everything an analyst may want to change lives here; operators take these values
as defaults and never repeat them.
"""

from __future__ import annotations

from dataclasses import dataclass

# --------------------------------------------------------------------------
# Fixed values. Results are comparable with published figures only while these
# brands, hosts, patterns and numbers stay exactly as written.
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Brand:
    brand: str
    domain: str
    is_client: bool
    search_term_re: str

    @property
    def name(self) -> str:
        """The domain without its top-level part, e.g. ``saatva``."""
        return self.domain.split(".")[0]


BRANDS = (
    Brand("Saatva", "saatva.com", True, "saatva"),
    Brand("Nectar", "nectarsleep.com", False, "nectar"),
    Brand("Helix", "helixsleep.com", False, "helix"),
    Brand("DreamCloud", "dreamcloudsleep.com", False, "dream ?cloud"),
    Brand("Walmart", "walmart.com", False, "walmart"),
)

RETAIL_BRAND = "Walmart"

# Affiliate-network redirect domains, any subdomain of them.
HOP_DOMAINS = (
    "prf.hn", "sjv.io", "pxf.io", "7eer.net", "evyy.net", "ojrq.net", "xuok.net", "vxf.io", "mlfo.net",
    "anrdoezrs.net", "jdoqocy.com", "tkqlhce.com", "dpbolvw.net", "kqzyfj.com", "qksrv.net", "awin1.com",
    "pntra.com", "pntrs.com", "pntrac.com", "gopjn.com", "pjtra.com", "pjatr.com",
)
# Redirect hosts matched exactly.
HOP_HOSTS = (
    "click.linksynergy.com", "shareasale.com", "avantlink.com", "track.flexlinkspro.com", "goto.walmart.com",
)

# Redirect hosts by network: domains (any subdomain) and exact hosts.
HOP_NETWORKS = (
    ("Partnerize", ("prf.hn",), ()),
    ("Pepperjam (Partnerize)", ("pntra.com", "pntrs.com", "pntrac.com", "gopjn.com", "pjtra.com", "pjatr.com"), ()),
    ("Impact", ("sjv.io", "pxf.io", "7eer.net", "evyy.net", "ojrq.net", "xuok.net", "vxf.io", "mlfo.net"),
     ("goto.walmart.com",)),
    ("CJ", ("anrdoezrs.net", "jdoqocy.com", "tkqlhce.com", "dpbolvw.net", "kqzyfj.com", "qksrv.net"), ()),
    ("Rakuten", (), ("click.linksynergy.com",)),
    ("Awin", (), ("awin1.com", "shareasale.com")),
    ("AvantLink", (), ("avantlink.com",)),
    ("FlexOffers", (), ("track.flexlinkspro.com",)),
)
HOP_NETWORK_DEFAULT = "Other"

# Publisher id in each network's link format: label, pattern.
HOP_PUBLISHERS = (
    ("camref:", r"camref:([0-9A-Za-z]+)"),
    ("impact:", r"/c/(\d+)/"),
    ("cj:", r"click-(\d+)-"),
    ("awin:", r"(?i)awinaffid=(\d+)"),
)

# Any of these in a landing URL marks it as an affiliate landing.
AFFILIATE_MARKER_RE = (
    r"(?i)[?&](irclickid=|cidimp=|irgwc=1|clickref=|app_clickref=|click_id=\d{4}l|cjevent=|cjdata=|ranmid="
    r"|ransiteid=|raneaid=|awc=|sscid=|avad=|veh=aff|wmlspartner=imp_"
    r"|utm_medium=(affiliate|affiliates|aff)(&|#|$))"
)
# Query parameters that may hold the network's click id, first present wins.
CLICK_ID_PARAMS = (
    "irclickid", "cidimp", "clickid", "click_id", "app_clickref", "clickref", "cjevent", "awc", "sscid", "avad",
)
# Network of a tagged landing, first match wins.
LANDING_NETWORKS = (
    ("Impact", r"(?i)[?&](irclickid|cidimp|irgwc)=|[?&]wmlspartner=imp_"),
    ("Partnerize", r"(?i)[?&](app_clickref|clickref)=|[?&]click_id=\d{4}l"),
    ("CJ", r"(?i)[?&](cjevent|cjdata)="),
    ("Rakuten", r"(?i)[?&](ranmid|ransiteid|raneaid)="),
    ("Awin", r"(?i)[?&]awc="),
    ("ShareASale", r"(?i)[?&]sscid="),
    ("AvantLink", r"(?i)[?&]avad="),
)
LANDING_NETWORK_DEFAULT = "UTM only"
RETAIL_PARTNER_RE = r"(?i)[?&]wmlspartner=imp_(\d+)"
PAID_SEARCH_ID_RE = r"(?i)[?&](gclid|gad_source|gbraid|wbraid|msclkid)="

# Source of a visit from its entry URL, first match wins (affiliate entries come first).
ENTRY_SOURCES = (
    ("Paid search",
     r"(?i)[?&](gclid|gad_source|gbraid|wbraid|msclkid|gclsrc)=|[?&]utm_medium=(cpc|ppc|sem|paid_?search)"),
    ("Social (paid/organic)",
     r"(?i)[?&](fbclid|ttclid|sccid|epik)=|[?&]utm_source=(facebook|fb|instagram|ig|meta|tiktok|pinterest|snapchat)"),
    ("Email / SMS", r"(?i)[?&]utm_medium=(e-?mail|newsletter|sms)"),
    ("Display / TV", r"(?i)[?&]utm_medium=(streaming|ctv|tv|display|video)"),
    ("Other tagged", r"(?i)[?&]utm_"),
)
ENTRY_SOURCE_AFFILIATE = "Affiliate"
ENTRY_SOURCE_DEFAULT = "Untagged (organic / direct / referral)"

URL_PATH_RE = r"^[a-z]+://[^/?#]+([^?#]*)"
URL_SECTION_RE = r"^[a-z]+://[^/?#]+(/[^/?#]*)"
CONVERSION_RE = (
    r"(?i)/(thank[-_]?you|thankyou|checkout/onepage/success|checkout/success|checkout/confirmation"
    r"|order[-_]?confirmation|order[-_]?complete|purchase/confirmation)(/|\?|#|$)"
)
CART_RE = r"(?i)/(cart|basket)(/|$)"
CHECKOUT_PAGE_RE = r"(?i)/checkouts?(/|$)"
CART_OR_CHECKOUT_RE = r"(?i)/(cart|basket|checkout|checkouts)(/|\?|#|$)"
REGISTRATION_RE = r"(?i)/(account/(create|signup|sign-up|register)|register|sign-?up|create-?account)(/|$)"
PRODUCT_PATH_RE = r"^/(ip|products?|mattresses|mattress-bundles|bedding|furniture|bed-frames|bases|pillows)/[^/?#]+"

FINANCING_DOMAINS = (
    "affirm.com", "klarna.com", "afterpay.com", "synchrony.com", "mysynchrony.com", "acima.com", "katapult.com",
    "snapfinance.com",
)
SEARCH_HOST_RE = (
    r"(^|\.)(google\.[a-z.]+|bing\.com|search\.yahoo\.com|duckduckgo\.com|search\.brave\.com|ecosia\.org"
    r"|search\.aol\.com|startpage\.com)$"
)
SEARCH_PARAMS = ("q", "p")
COUPON_DOMAINS = (
    "joinhoney.com", "honey.io", "capitaloneshopping.com", "rakuten.com", "retailmenot.com", "karmanow.com",
    "coupert.com", "couponbirds.com", "dealspotr.com", "couponcabin.com", "topcashback.com", "befrugal.com",
    "swagbucks.com", "slickdeals.net", "couponfollow.com", "simplycodes.com", "wethrift.com", "savings.com",
)
# Country-code domains that mark an event as non-US (codes used generically world-wide are left out).
NON_US_CCTLDS = (
    "uk", "ca", "au", "de", "fr", "in", "br", "mx", "jp", "es", "it", "nl", "pl", "se", "tr", "ru", "ar", "cl",
    "pe", "za", "ph", "id", "my", "sg", "nz", "ie", "pk", "ng", "kr", "vn", "th", "eg", "sa", "ae", "il", "ro",
    "cz", "gr", "pt", "ch", "at", "be", "dk", "fi", "no", "hu", "ua", "cn", "tw", "hk", "bd", "ke", "ir",
)
MATTRESS_BRANDS = (
    "saatva", "nectarsleep", "helixsleep", "dreamcloudsleep", "casper", "purple", "tempurpedic", "sleepnumber",
    "mattressfirm", "tuftandneedle", "avocadogreenmattress", "brooklynbedding", "zinus", "bearmattress", "puffy",
    "amerisleep", "birchliving", "laylasleep", "nolahmattress", "sealy", "serta", "sienasleep", "novilla",
)
REVIEW_DOMAINS = (
    "mattressclarity.com", "sleepfoundation.org", "mattressnerd.com", "sleepopolis.com", "top5-mattresses.com",
    "buyersguide.org", "sleepadvisor.org", "nytimes.com", "tomsguide.com", "goodhousekeeping.com", "cnn.com",
    "forbes.com", "usatoday.com",
)
CROSS_SHOPPING_FOCUS = (
    ("saatva", "Saatva"), ("nectarsleep", "Nectar"), ("helixsleep", "Helix"), ("dreamcloudsleep", "DreamCloud"),
)
COVERAGE_SITES = (
    ("google.com", "Search"), ("bing.com", "Search"),
    ("youtube.com", "Video / social"), ("facebook.com", "Video / social"), ("tiktok.com", "Video / social"),
    ("amazon.com", "Retail"), ("ebay.com", "Retail"), ("target.com", "Retail"), ("walmart.com", "Retail"),
    ("temu.com", "Retail"), ("shein.com", "Retail"),
    ("paypal.com", "Payments"),
    ("msn.com", "News / portal"), ("nytimes.com", "News / portal"), ("cnn.com", "News / portal"),
    ("foxnews.com", "News / portal"), ("weather.com", "News / portal"),
    ("capitaloneshopping.com", "Coupon / cash-back"), ("rakuten.com", "Coupon / cash-back"),
    ("slickdeals.net", "Coupon / cash-back"), ("joinhoney.com", "Coupon / cash-back"),
    ("retailmenot.com", "Coupon / cash-back"),
)
ACTIVITY_TIERS = (
    (21, "1 Light (≤ median)"), (141, "2 Mid (to p90)"), (600, "3 Heavy (p90–p99)"),
    (5000, "4 Very heavy (> p99)"), (None, "5 Extreme (> 5,000 events)"),
)
EXTREME_EVENTS = 5000
FUNNEL_STEPS = (
    "Mattress shoppers (review or brand site)", "Read a review / comparison", "Visited a mattress brand site",
    "Viewed a product page", "Reached cart", "Reached checkout", "Ordered",
)
SIGNAL_LABELS = (
    "0 Click without landing (stuffing)", "1 Injected at cart/checkout", "2 User already on brand site",
    "3 Publisher-bought search ad", "4 Brand search just before", "5 Coupon/cash-back just before",
    "6 Multi-brand burst (review)", "7 No visible referrer (weak)", "8 No hijack indicator",
)
STAGE_LABELS = (
    "0 Never reached the site", "1 Click starts the visit", "2 Already browsing the site",
    "3 Already on a product page", "4 Already in cart", "5 Already at checkout",
)
CLICK_BUCKETS = ((50, "5 50+"), (20, "4 20-49"), (10, "3 10-19"), (4, "2 4-9"), (1, "1 1-3"))
JOURNEY_PATTERNS = (
    "Brand sites only", "Review sites only", "Review first, then a brand", "Brand first, then a review",
)

# External monthly site visits (one month, 31 days) and US share, by domain.
BENCHMARKS = (
    ("walmart.com", 581.7e6, 0.9519),
    ("saatva.com", 2.3e6, 0.9248),
    ("nectarsleep.com", 5.1e6, 0.9656),
    ("dreamcloudsleep.com", 1.9e6, 0.9679),
    ("helixsleep.com", None, 0.9182),
)
BENCHMARK_DAYS = 31
BENCHMARK_SOURCE = "Similarweb (Aug 2026)"
BENCHMARK_SOURCE_HIDDEN = "Similarweb (Aug 2026), visits not public"
BENCHMARK_URL = "https://www.similarweb.com/website/{domain}/"
US_INTERNET_USERS = 324e6
BENCHMARK_CR_LOW = 0.005
BENCHMARK_CR_HIGH = 0.02
MIN_ORDERS_FOR_RATE = 10

VISIT_GAP_S = 1800
HOP_LANDING_S = 60
HOP_CHAIN_S = 10
CONTEXT_BEFORE_S = 1800
CONTEXT_AFTER_S = 120
SEARCH_BEFORE_S = 60
COUPON_BEFORE_S = 60
BURST_S = 120
BURST_MIN_HOSTS = 2
FLOOD_MIN_CLICKS = 20
FLOOD_THRESHOLDS = (10, 20, 50)
MIRROR_MIN_SHARED = 3
NON_US_PCT = 20
MIN_REPORT_CLICKS = 5
LOOK_BACKS = ((1800, "30 min (base)"), (600, "10 min"), (120, "2 min"))
COUPON_WEIGHTS = (
    (1.0, "1 (as observed)"), (0.5, "0.5 (panel holds them at 2x)"), (0.25, "0.25 (at 4x)"), (0.0, "0 (dropped)"),
)

ANCHOR_ORDER_S = 120 * 60
ANCHOR_REFERRED_S = 30 * 60
ANCHOR_INJECTED_S = 60 * 60

# Average order value and commission rate, low and high, for the money at risk.
RETAIL_AOV = (100, 125)
RETAIL_COMMISSION = (0.01, 0.04)
CLIENT_BRAND = "Saatva"
CLIENT_AOV = 860
CLIENT_COMMISSION = (0.03, 0.10)
CLIENT_SHARE_STEP = 0.1

# Seasonal series: the week around the panel day and the benchmark month.
SEASON_WEEK = ("2026-04-28", "2026-05-04")
SEASON_MONTH = 8
MAY_CALIBRATION = ("Saatva", "Nectar", "DreamCloud")

# Publisher monitor.
JOURNEY_STEPS_BEFORE = 6
JOURNEY_STEPS_AFTER = 2
MIN_SITE_USERS = 20
OTHER_SITE = "other site"
NETWORK_SITE_DOMAINS = (
    "prf.hn", "pntra.com", "pntrs.com", "pntrac.com", "gopjn.com", "pjtra.com", "pjatr.com", "sjv.io", "pxf.io",
    "7eer.net", "evyy.net", "ojrq.net", "xuok.net", "vxf.io", "mlfo.net", "anrdoezrs.net", "jdoqocy.com",
    "tkqlhce.com", "dpbolvw.net", "kqzyfj.com", "qksrv.net", "linksynergy.com", "awin1.com", "shareasale.com",
    "avantlink.com", "flexlinkspro.com",
)
NETWORK_SITE_HOSTS = ("goto.walmart.com",)
ADULT_HOST_RE = (
    r"(?i)porn|xxx|sex|nude|adult|shemale|ladyboy|tranny|escort|cam4|chaturbate|onlyfans|xvideos|xhamster|hentai"
    r"|milf|nsfw|fetish|erotic|redtube|youporn|brazzers|spankbang|rule34|eporner|motherless|stripchat"
    r"|bongacams|livejasmin|myfreecams|fapello"
)
ECONOMICS = (
    ("Walmart", 112.5, 2.5), ("Saatva", 860.0, 5.0), ("Nectar", 860.0, 5.0), ("Helix", 860.0, 5.0),
    ("DreamCloud", 860.0, 5.0),
)
HOLD_MIN_ORDERS = 3
HOLD_FLAGGED_PCT = 50
REVIEW_FLAGGED_PCT = 20
STATUS_LABELS = ("Hold payouts", "Review", "OK")

# Sources of a click, groups of the checkout test, lines of the commission estimate, dimensions of the segments.
CLICK_TAGGED, CLICK_HOP_PAGE, CLICK_HOP_ONLY = "tagged landing", "hop + untagged landing", "hop, no landing"
GROUP_INJECTED, GROUP_CONTROL = "Affiliate click fired after this point", "No affiliate click"
SCOPE_STRONG = "All strong indicators"
SCOPE_INJECTED = "Injected at cart/checkout (tested in this step)"
SCOPE_CLIENT = "Per 10% of affiliate orders hijacked"
SEGMENT_COUPON, SEGMENT_ACTIVITY = "Coupon / cash-back user", "Activity tier"
# A query parameter, key in any case; its raw value is the group.
URL_PARAM_RE = r"(?i)[?&]{key}=([^&#]*)"

"""Random clickstreams full of ties, against the SQL statements.

The driver tables never put two hosts, several clicks or several hops into one second, and
know few networks. These streams do: few persons, few seconds, many kinds of pages.
"""

import datetime as dt
import random

import duckdb
import pyarrow as pa
import pytest

from oracle import sql
from panelscope.plans.stages import INTERNAL, TABLES, Workspace
from panelscope.plans.store import TableStore
from tests.compare import assert_same

DAY = dt.datetime(2026, 5, 1)
PAGES = [
    ("saatva.com", "https://www.saatva.com/"),
    ("saatva.com", "https://www.saatva.com/mattresses/classic"),
    ("saatva.com", "https://www.saatva.com/cart"),
    ("saatva.com", "https://www.saatva.com/checkout"),
    ("saatva.com", "https://www.saatva.com/checkout/onepage/success?x=1"),
    ("saatva.com", "https://www.saatva.com/?next=/thankyou"),
    ("sgtm.saatva.com", "https://sgtm.saatva.com/cart/a"),
    ("www.walmart.com", "https://www.walmart.com/ip/1"),
    ("walmart.com", "https://www.walmart.com/ip/2"),
    ("walmart.com", "https://www.walmart.com/cart"),
    ("walmart.com", "https://www.walmart.com/checkout/review"),
    ("walmart.com", "https://www.walmart.com/thankyou?o=1"),
    ("walmart.com", "https://www.walmart.com/account/signup"),
    ("walmart.com", "https://www.walmart.com/ip/3?utm_medium=cpc"),
    ("walmart.com", "https://www.walmart.com/ip/3?utm_source=tiktok"),
    ("walmart.com", "https://www.walmart.com/ip/3?utm_medium=e-mail"),
    ("casper.com", "https://casper.com/products/one"),
    ("nytimes.com", "https://www.nytimes.com/wirecutter/best-Mattress"),
    ("nytimes.com", "https://www.nytimes.com/news"),
    ("google.com", "https://www.google.com/search?q=walmart+mattress"),
    ("google.co.uk", "https://www.google.co.uk/search?q=dream%20cloud"),
    ("search.yahoo.com", "https://search.yahoo.com/search?p=SAATVA"),
    ("bing.com", "https://www.bing.com/search?q=%C4%E3"),
    ("slickdeals.net", "https://slickdeals.net/f/1"),
    ("capitaloneshopping.com", "https://capitaloneshopping.com/s"),
    ("affirm.com", "https://www.affirm.com/apply?m=www.saatva.com%2Fcart"),
    ("klarna.com", "https://klarna.com/pay?shop=walmart+and+helixsleep"),
    ("xvideos.com", "https://xvideos.com/"),
    ("rare-blog.net", "https://rare-blog.net/a"),
    ("other-blog.net", "https://other-blog.net/b"),
    ("news.co.uk", "https://news.co.uk/a"),
    ("saatva.prf.hn", "https://saatva.prf.hn/click/camref:1011abc/destination:https%3A%2F%2Fwww.saatva.com%2F"),
    ("goto.walmart.com", "https://goto.walmart.com/c/123/x?u=https%3A%2F%2Fwww.walmart.com%2Fip%2F1"),
    ("goto.walmart.com", "https://goto.walmart.com/c/124/x?u=https%3A%2F%2Fwww.walmart.ca%2Fip%2F1"),
    ("goto.walmart.com", "https://goto.walmart.com/c/125/x?u=https://nectarsleep.com/%C4%E3"),
    ("www.anrdoezrs.net", "https://www.anrdoezrs.net/click-55-66?url=https%3A%2F%2Fhelixsleep.com"),
    ("awin1.com", "https://awin1.com/cread.php?awinaffid=77&ued=https%3A%2F%2Fdreamcloudsleep.com"),
    ("app.impact.com", "https://app.impact.com/walmart.com"),
]
MARKERS = [
    "click_id=1100l{i}&utm_medium=affiliate&utm_source=Pub", "irclickid={i}&coupon=A%20B", "cidimp={i}&utm_source=%E9x",
    "wmlspartner=imp_77&clickid={i}&veh=aff", "cjevent={i}", "ranMID=1&ranSiteID=S{i}", "awc={i}&gclid=1", "sscid={i}",
    "avad={i}&sharedid=sub", "utm_medium=aff", "clickref={i}&utm_sharedid=z%zz", "veh=aff&wmlspartner=imp_88",
]
BRAND_PAGES = ["saatva.com", "nectarsleep.com", "helixsleep.com", "dreamcloudsleep.com", "walmart.com"]


def stream(seed: int, users: int, seconds: int, events: int):
    r = random.Random(seed)
    rows = []
    for i in range(events):
        user, second = r.randrange(users), r.randrange(seconds)
        if r.random() < 0.2:
            second = second // 60 * 60
        if r.random() < 0.35:
            host = r.choice(BRAND_PAGES)
            url = f"https://www.{host}/p?{r.choice(MARKERS).format(i=r.randrange(events // 10))}"
        else:
            host, url = r.choice(PAGES)
        at = DAY + dt.timedelta(seconds=second)
        rows.append((f"e{i:06d}", f"u{user}", f"s{user}-{r.randrange(3)}", at, host, url))
        if r.random() < 0.15:
            rows.append((f"f{i:06d}", f"u{user}", f"s{user}-9", at, host, url))
        if user % 4 == 0 and r.random() < 0.6:
            rows.append((f"g{i:06d}", f"u{user}m", f"s{user}-m", at, host, url))
    return rows


@pytest.fixture(scope="module", params=[(1, 6, 900, 1500), (2, 25, 86400, 4000), (3, 10, 3 * 86400, 4000)], ids=["dense", "sparse", "three days"])
def streams(request, spark):
    rows = stream(*request.param)
    schema = "event_id string, user_id string, session_id string, created_time timestamp_ntz, host string, url string"
    store = TableStore(spark)
    raw = store.write("raw_clicks", spark.createDataFrame(rows, schema))
    con = duckdb.connect()
    names = ["event_id", "user_id", "session_id", "created_time", "host", "url"]
    con.register("stream", pa.table({n: [row[i] for row in rows] for i, n in enumerate(names)}))
    con.execute("CREATE TABLE micro AS SELECT * REPLACE (CAST(created_time AS TIMESTAMP) AS created_time) FROM stream")
    return Workspace(spark, raw, None, store), con


@pytest.mark.parametrize("name", [
    n for n in TABLES if n not in INTERNAL and n not in ("seasonal_ratio", "seasonal_scaling")])
def test_table(streams, name):
    work, con = streams
    assert_same(work.table(name), con, sql.statement(name, raw_clicks="SELECT * FROM micro"))

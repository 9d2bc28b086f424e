"""Expression rules that are easy to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelscope.functions import exprs as X


def value(spark, column, **row):
    cols = {k: F.lit(v) for k, v in row.items()}
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("query, expected", [
    ("q=a+b%20c", "a+b c"),              # plus stays, escapes are decoded
    ("Q=upper", "upper"),                # key in any case
    ("q=%C4%E3", "%C4%E3"),              # bytes that are not UTF-8 stay as written
    ("q=100%&x=1", "100%"),              # a stray percent sign stays
    ("q=%zz%41", "%zzA"),                # and does not stop the rest from being decoded
    ("q=", None), ("x=1", None),
    ("xq=1", None),                      # only whole keys
    ("q=1#frag", "1"),
    ("q=%EF%BF%BD", "�"),           # an encoded replacement character is valid text
])
def test_url_param(spark, query, expected):
    assert value(spark, X.url_param(F.col("u"), "q"), u=f"https://a.com/p?{query}") == expected


@pytest.mark.parametrize("url, path, section", [
    ("https://a.com/cart/x?q=/thankyou#y", "/cart/x", "/cart"),
    ("https://a.com", "", "/"),
    ("https://a.com?x=1", "", "/"),
    ("HTTPS://a.com/cart", "", "/"),     # lower-case schemes only
])
def test_url_parts(spark, url, path, section):
    assert value(spark, X.url_path(F.col("u")), u=url) == path
    assert value(spark, X.url_section(F.col("u")), u=url) == section


@pytest.mark.parametrize("x, digits, expected", [
    (1.005, 2, 1.0), (2.675, 2, 2.68), (0.125, 2, 0.13), (2.5, 0, 3.0), (-2.5, 0, -3.0), (-0.04, 1, 0.0)])
def test_round_half(spark, x, digits, expected):
    assert value(spark, X.round_half(F.col("x"), digits), x=x) == expected


def test_ratios_of_zero(spark):
    assert value(spark, X.ratio(F.col("a"), F.col("b")), a=1, b=0) is None
    assert value(spark, X.pct(F.col("a"), F.col("b")), a=1, b=3) == 100.0 / 3


@pytest.mark.parametrize("n, low, high", [(0, 0, 10213), (2, 625, 20106), (4, 2996, 28515), (6, 6100, 36364)])
def test_byar_limits(spark, n, low, high):
    scale = 2784.4065142499217
    assert round(value(spark, X.byar_low(F.col("n")), n=n) * scale) == low
    assert round(value(spark, X.byar_high(F.col("n")), n=n) * scale) == high


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_seconds_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        for text, sec in (("2026-03-08 02:30:00", 1772937000), ("2026-11-01 01:30:00", 1793496600)):
            ts = F.lit(text).cast("timestamp_ntz")
            row = spark.range(1).select(X.event_second(ts).alias("s"), X.second_to_ts(F.lit(sec)).alias("t")).first()
            assert row["s"] == sec
            assert row["t"] == dt.datetime.fromisoformat(text)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_first_by_skips_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "a")], "t int, v string")
    assert df.agg(X.first_by(F.col("v"), F.col("t")).alias("v")).first()["v"] == "b"


@pytest.mark.parametrize("host, inside", [
    ("prf.hn", True), ("saatva.prf.hn", True), ("xprf.hn", False), ("click.linksynergy.com", True),
    ("a.click.linksynergy.com", False), ("linksynergy.com", False)])
def test_host_in(spark, host, inside):
    assert value(spark, X.host_in("h", ("prf.hn",), ("click.linksynergy.com",)), h=host) is inside


@pytest.mark.parametrize("host, foreign", [("a.co.uk", True), ("uk", False), ("a.com", False), ("b.io", False)])
def test_non_us_host(spark, host, foreign):
    assert value(spark, X.is_non_us_host("h"), h=host) is foreign

"""Column expressions shared by all operators.

The rules that are easy to get wrong (time in whole seconds, escapes, empty
parameters, rounding, division by zero, first non-null value) live only here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelscope import config as C


# -- time --------------------------------------------------------------------

_EPOCH = "1970-01-01 00:00:00"


def event_second(ts: str | Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (ts - F.lit(_EPOCH).cast("timestamp_ntz")).cast("interval second").cast("bigint")


def second_to_ts(sec: str | Column) -> Column:
    """Inverse of :func:`event_second`."""
    sec = F.col(sec) if isinstance(sec, str) else sec
    return F.lit(_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=sec.cast("decimal(18,6)"))


# -- hosts -------------------------------------------------------------------

def registered_domain(host: str | Column) -> Column:
    """Last two labels of a host: ``www.saatva.com`` -> ``saatva.com``."""
    host = F.col(host) if isinstance(host, str) else host
    return F.substring_index(host, ".", -2)


def host_in(host: str | Column, domains=(), hosts=()) -> Column:
    """Host is one of ``hosts``, or one of the two-label ``domains`` or any subdomain of it."""
    host = F.col(host) if isinstance(host, str) else host
    cond = F.lit(False)
    if domains:
        cond = cond | registered_domain(host).isin(*domains)
    if hosts:
        cond = cond | host.isin(*hosts)
    return cond


def is_non_us_host(host: str | Column) -> Column:
    host = F.col(host) if isinstance(host, str) else host
    return host.contains(".") & F.substring_index(host, ".", -1).isin(*C.NON_US_CCTLDS)


def brand_of_domain(domain: Column) -> Column:
    """Brand of a bare brand domain, NULL for anything else."""
    out = None
    for b in C.BRANDS:
        out = F.when(domain == b.domain, b.brand) if out is None else out.when(domain == b.domain, b.brand)
    return out


# -- URLs --------------------------------------------------------------------

_REPLACEMENT = "�"


def decode_escapes(text: Column) -> Column:
    """Percent-decode: ``+`` stays, a stray ``%`` stays, bytes that are not UTF-8 give NULL."""
    safe = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.try_url_decode(safe)
    garbled = decoded.contains(_REPLACEMENT) & ~text.rlike("(?i)%EF%BF%BD|" + _REPLACEMENT)
    return F.when(~garbled, decoded)


def decoded_or_raw(text: Column) -> Column:
    return F.coalesce(decode_escapes(text), text)


def extract(text: Column, pattern: str) -> Column:
    """First group of the first match; NULL when absent or empty."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def raw_param(url: Column, key: str) -> Column:
    """Value of a query parameter (key in any case) as written; empty when absent."""
    return F.regexp_extract(url, C.URL_PARAM_RE.format(key=key), 1)


def param_value(raw: Column) -> Column:
    """Decoded value of a raw parameter; NULL when empty."""
    return F.when(raw.contains("%"), F.nullif(decoded_or_raw(raw), F.lit(""))).when(raw != "", raw)


def url_param(url: Column, key: str) -> Column:
    """Decoded value of a query parameter (key in any case); NULL when absent or empty."""
    return param_value(raw_param(url, key))


def url_path(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(url, C.URL_PATH_RE, 1)


def url_section(url: str | Column) -> Column:
    """First path segment with its slash; ``/`` when the URL has no path."""
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(extract(url, C.URL_SECTION_RE), F.lit("/"))


def has_affiliate_marker(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return url.rlike(C.AFFILIATE_MARKER_RE)


def is_cart_path(path: Column) -> Column:
    return path.rlike(C.CART_RE)


def is_checkout_path(path: Column) -> Column:
    return path.rlike(C.CHECKOUT_PAGE_RE) & ~path.rlike(C.CART_RE)


def first_match(text: Column, rules, default: str) -> Column:
    """Label of the first pattern that matches."""
    out = F
    for label, pattern in rules:
        out = out.when(text.rlike(pattern), label)
    return out.otherwise(default)


# -- aggregates --------------------------------------------------------------

def count_where(cond: Column) -> Column:
    """Rows where the condition is true, as a long."""
    return F.count(F.when(cond, F.lit(1)))


def first_by(value: Column, order: Column) -> Column:
    """First non-null value in the given order."""
    return F.min_by(value, F.when(value.isNotNull(), order))


# -- numbers -----------------------------------------------------------------

def ratio(n: Column, d: Column) -> Column:
    """``n / d`` in doubles; NULL when the denominator is zero."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def pct(n: Column, d: Column) -> Column:
    """Unrounded percentage, multiplied before dividing."""
    return F.try_divide(n.cast("double") * F.lit(100.0), d.cast("double"))


def round_half(x: Column, digits: int = 0) -> Column:
    """Round the binary double half away from zero (``1.005`` to 2 digits is ``1.0``)."""
    scale = F.lit(float(10 ** digits))
    up = F.floor(F.abs(x) * scale + F.lit(0.5)).cast("double")
    return F.when(x < 0, -up).otherwise(up) / scale


def byar_low(n: Column) -> Column:
    """Lower 95 % limit of a Poisson count (Byar's approximation)."""
    n = n.cast("double")
    inner = F.lit(1.0) - F.try_divide(F.lit(1.0), n * 9.0) - F.try_divide(F.lit(1.96), F.sqrt(n) * 3.0)
    return F.when(n == 0, F.lit(0.0)).otherwise(n * F.pow(inner, F.lit(3.0)))


def byar_high(n: Column) -> Column:
    """Upper 95 % limit of a Poisson count (Byar's approximation)."""
    m = n.cast("double") + 1.0
    inner = F.lit(1.0) - F.lit(1.0) / (m * 9.0) + F.lit(1.96) / (F.sqrt(m) * 3.0)
    return m * F.pow(inner, F.lit(3.0))

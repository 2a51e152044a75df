"""Functions of addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Public suffixes of two labels that matter for news sites; all others are of one.
TWO_LABEL_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.kr", "co.in", "com.br", "com.mx", "com.cn", "com.hk", "com.sg", "com.tr", "co.za"]


def host(url: Column) -> Column:
    """Lower-cased host without user and port; null if there is none."""
    h = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(h, F.lit(""))


def scheme(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(url), r"^([a-z][a-z0-9+.-]*)://", 1), F.lit(""))


def is_valid(url: Column) -> Column:
    return F.coalesce(scheme(url).isin("http", "https") & host(url).isNotNull(), F.lit(False))


def domain(url: Column) -> Column:
    """Registered domain: the public suffix and one label."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    return F.when(host(url).isNull(), F.lit(None)).when((n >= 3) & last(2).isin(TWO_LABEL_SUFFIXES), last(3)).otherwise(last(2))


def is_english(url: Column) -> Column:
    """By the path only. '/en' anywhere counts, even in '/entertainment'; else none of some other languages' folders may be there."""
    u = F.lower(url)
    return u.contains("/en") | ~u.rlike("/(zh|cn|fr|de|es|ja|ko)/")


def news_source(source: Column, url: Column) -> Column:
    """news/<host>, of the source or else the address; without www."""
    h = F.coalesce(host(source), F.nullif(F.regexp_replace(F.lower(F.trim(source)), r"[:/].*$", ""), F.lit("")), host(url))
    return F.concat(F.lit("news/"), F.coalesce(F.regexp_replace(h, r"^www\.", ""), F.lit("unknown")))


def post_slug(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/p/([^?#/]+)", 1), F.lit(""))


def percent_encode(x: Column) -> Column:
    return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))


def proxy_url(spec: Column, protocol: str = "http") -> Column:
    """host:port or host:port:user:password as an address; one that already is stays; others are null."""
    p = F.split(F.trim(spec), ":")
    auth = F.concat(F.lit(f"{protocol}://"), percent_encode(F.get(p, F.lit(2))), F.lit(":"), percent_encode(F.array_join(F.slice(p, 4, F.greatest(F.size(p) - 3, F.lit(1))), ":")), F.lit("@"), F.get(p, F.lit(0)), F.lit(":"), F.get(p, F.lit(1)))
    return F.when(spec.contains("://"), F.trim(spec)).when(F.size(p) == 2, F.concat(F.lit(f"{protocol}://"), F.trim(spec))).when(F.size(p) >= 4, auth)

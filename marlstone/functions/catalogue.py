"""Book catalogues and reports: slugs, tables of contents, pages, and the records that rows of harvests become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as X


def book_slug(x: Column) -> Column:
    return F.regexp_replace(F.trim(x, F.lit("/")), "^books/", "")


def toc_refs(html: Column) -> Column:
    """References to pages (./*.xhtml) of a table of contents, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""<a\b[^>]*?\bhref\s*=\s*["']\s*\./([^"']*\.xhtml)\s*["']"""), F.lit(1)))


def page_hash(x: Column) -> Column:
    return F.left(F.sha1(F.coalesce(x, F.lit(""))), F.lit(16))


def primary_subject(subjects: Column) -> Column:
    return F.coalesce(F.get(subjects, F.lit(0)), F.lit("Unknown"))


def _record(df: DataFrame, source: str, day: Column, payload: Column) -> DataFrame:
    url = F.col("url")
    rid = X.record_id(F.lit(source), url, day, payload["title"])
    return df.select(rid.alias("id"), F.lit("kb").alias("kind"), F.lit(source).alias("source"), day.alias("timestamp"), url.alias("url"), payload.alias("payload")).filter(F.col("timestamp") != "")


def _day(x: Column) -> Column:
    return F.coalesce(F.date_format(F.to_timestamp(F.nullif(F.trim(x), F.lit(""))), "yyyy-MM-dd"), F.left(F.trim(F.coalesce(x, F.lit(""))), F.lit(10)))


def books(df: DataFrame) -> DataFrame:
    """Records of book pages (pubtime, url, title, page_title, content) that have a day; no window of days applies to books."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return _record(df, "book/openstax", _day(F.col("pubtime")), F.struct(empty("title"), empty("page_title"), empty("content")))


def reports(df: DataFrame, first: str, last: str) -> DataFrame:
    """Records of reports (datestamp, url, title, content) of the days from first to last."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return _record(df, "report/world_bank", _day(F.col("datestamp")), F.struct(empty("title"), empty("content"))).filter(F.col("timestamp").between(first, last))

"""Hits of an external search, the texts that rerankers and models see of hits, and dates that tools may ask for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import text as X


def _text(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit("")))


def source_type(wanted: Column) -> Column:
    """The first of a comma-joined list of sources, lower-cased, without its kind; empty if there is none."""
    first = F.get(F.filter(F.transform(F.split(F.lower(F.coalesce(wanted, F.lit(""))), ","), lambda s: F.trim(s)), lambda s: s != ""), F.lit(0))
    return F.coalesce(F.regexp_replace(first, r"^[^/]*/", ""), F.lit(""))


def inferred_type(url: Column) -> Column:
    return F.when(F.lower(_text(url)).endswith(".pdf"), "paper").otherwise("news")


def published(direct: Column, extras: Column) -> Column:
    """When a result was published: as it says itself, or by the first key of its further fields (JSON) that says so; else empty."""
    other = [F.get_json_object(extras, f"$.{k}") for k in ("published_date", "publishedDate", "published_at", "publishedAt")]
    return F.coalesce(*[F.nullif(_text(x), F.lit("")) for x in (direct, *other)], F.lit(""))


def clean_lines(x: Column) -> Column:
    """Lines without blanks at their ends; blank lines go."""
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"\r\n|[\n\r]"), lambda s: F.trim(s)), lambda s: s != ""), "\n")


def result_text(summary: Column, highlights: Column, text: Column) -> Column:
    """The summary, else the highlights in a row, else the text."""
    joined = F.array_join(F.filter(F.transform(F.coalesce(highlights, F.array().cast("array<string>")), _text), lambda s: s != ""), " ")
    return F.coalesce(F.nullif(_text(summary), F.lit("")), F.nullif(joined, F.lit("")), clean_lines(text))


def compose_prefixed(title: Column, content: Column) -> Column:
    """The title above the content, unless the content has it at its beginning."""
    t, c = _text(title), _text(content)
    has = F.contains(F.lower(F.left(c, F.length(t) + 8)), F.lower(t))
    return F.when(t == "", c).when(c == "", t).when(has, c).otherwise(F.concat(t, F.lit("\n"), c))


def rerank_text(title: Column, content: Column) -> Column:
    """What a reranker reads: the title above the content, unless the content begins with it."""
    t, c = _text(title), _text(content)
    return F.when(t == "", c).when(c == "", t).when(F.startswith(F.lower(c), F.lower(t)), c).otherwise(F.concat(t, F.lit("\n"), c))


def external_hit(id_: Column, url: Column, title: Column, score: Column, summary: Column, highlights: Column, text: Column, date: Column, extras: Column, wanted: Column) -> Column:
    """A hit of the usual form from a result of an external search."""
    u, t = F.nullif(_text(url), F.lit("")), _text(title)
    kind = F.coalesce(F.nullif(source_type(wanted), F.lit("")), inferred_type(url))
    return F.struct(
        F.coalesce(F.nullif(F.coalesce(id_, F.lit("")), F.lit("")), u, t).alias("doc_id"), F.bround(F.coalesce(score, F.lit(0.0)), 4).alias("score"), F.concat(F.lit("info/"), kind).alias("source"),
        kind.alias("source_type"), F.left(published(date, extras), F.lit(10)).alias("timestamp"), t.alias("title"), compose_prefixed(t, result_text(summary, highlights, text)).alias("content"), u.alias("url"),
    )


def tool_day(x: Column) -> Column:
    """The day of a date, or of a time after whose T is cut."""
    return F.substring_index(_text(x), "T", 1).try_cast("date")


def clamped_dates(start: Column, end: Column, cutoff: Column, days: int = 90) -> Column:
    """start and end of a request, none after the cutoff day: without an end the cutoff, without a start (or with one after the end) so many days before the end."""
    last = F.least(F.coalesce(end, cutoff), cutoff)
    first = F.date_sub(last, days)
    return F.struct(F.when(F.coalesce(start <= last, F.lit(False)), start).otherwise(first).alias("start_date"), last.alias("end_date"))


def cutoff_of(asked: Column, default: Column) -> Column:
    """The asked cutoff, else the default; an error if there is none."""
    return F.coalesce(F.nullif(_text(asked), F.lit("")), F.nullif(_text(default), F.lit("")), F.raise_error(F.lit("a cutoff is needed")).cast("string"))


def truncated(content: Column, tokens: int) -> Column:
    """The first so many words, with dots if there are more."""
    words = F.split(_text(content), r"\s+")
    return F.when(F.size(words) <= tokens, content).otherwise(F.concat(F.array_join(F.slice(words, 1, tokens), " "), F.lit("...")))


def description_of(content: Column) -> Column:
    """The first 240 characters of a content in one line; null if it is blank."""
    return F.nullif(F.left(X.clean(content), F.lit(240)), F.lit(""))


def content_chars(content: Column) -> Column:
    return F.length(F.trim(F.coalesce(content, F.lit(""))))


def chosen_markdown(fit: Column, raw: Column) -> Column:
    """The fitted Markdown, else the raw one, else nothing; what is blank is none."""
    some = lambda x: F.when(F.trim(x) != "", x)
    return F.coalesce(some(fit), some(raw), F.lit(""))


def is_connect_failure(reason: Column, engine: str = "engine_exception:") -> Column:
    """Whether a fetching engine's exception says that no connection came about."""
    r = F.lower(_text(reason))
    return r.startswith(engine) & (r.contains("connecttimeout") | r.contains("connecterror") | r.contains("all connection attempts failed"))


def masked_proxy(x: Column) -> Column:
    """A proxy without its user and password; `direct` for none."""
    raw = _text(x)
    parts = F.split(raw, ":")
    scheme = F.substring_index(raw, "://", 1)
    signed = F.contains(raw, F.lit("://")) & F.contains(raw, F.lit("@"))
    four = F.concat(F.get(parts, F.lit(0)), F.lit(":"), F.get(parts, F.lit(1)), F.lit(":***:***"))
    return F.when(raw == "", "direct").when(signed, F.concat(scheme, F.lit("://***:***@"), F.substring_index(raw, "@", -1))).when(F.size(parts) >= 4, four).otherwise(raw)

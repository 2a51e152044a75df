"""Parts of JSON payloads, as functions of columns of JSON text. Null stays null unless said otherwise; text that is no JSON has no parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OBJECT = "map<string,string>"


def _part(x: Column, path: str) -> Column:
    return F.get_json_object(x, path)


def _some(*x: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in x])


def texts(x: Column) -> Column:
    """Elements of a JSON list as texts, objects as JSON; empty for null, for what is no list and for what is no JSON."""
    t = F.trim(F.coalesce(x, F.lit("")))
    return F.when(t.startswith("["), F.coalesce(F.from_json(t, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def outcomes(x: Column) -> Column:
    return F.transform(texts(x), lambda s: F.trim(s))


def prices(x: Column) -> Column:
    """Numbers of a JSON list; what is no number goes."""
    return F.filter(F.transform(texts(x), lambda s: s.try_cast("double")), lambda p: p.isNotNull())


def is_binary(outcomes_: Column) -> Column:
    return (F.size(outcomes_) == 2) & F.forall(outcomes_, lambda s: F.coalesce(s != "", F.lit(False)))


def is_resolved(status: Column, closed: Column, prices_: Column) -> Column:
    """Said to be resolved, or closed with one of two prices at the top and the other at the bottom."""
    told = F.lower(F.trim(F.coalesce(status, F.lit("")))) == "resolved"
    return told | (F.coalesce(closed, F.lit(False)) & (F.size(prices_) == 2) & (F.array_max(prices_) >= 0.95) & (F.array_min(prices_) <= 0.05))


def binary_answer(prices_: Column) -> Column:
    """1 if the first of two prices isn't below the second, else 0; null for other numbers of prices."""
    return F.when(F.size(prices_) == 2, (F.get(prices_, F.lit(0)) >= F.get(prices_, F.lit(1))).cast("int"))


def first_text(x: Column) -> Column:
    """First element of a JSON list."""
    return F.get(texts(x), F.lit(0))


def market_times(market: Column) -> Column:
    """Texts of the times that a market opens, closes and resolves, each with the time that stands in for it."""
    return F.struct(_some(_part(market, "$.startDate"), _part(market, "$.createdAt")).alias("open"), _some(_part(market, "$.endDate"), _part(market, "$.closedTime")).alias("close"), _some(_part(market, "$.closedTime"), _part(market, "$.updatedAt")).alias("resolve"))


def resolution_criteria(description: Column, source: Column) -> Column:
    """The description, and the source of the resolution if the description lacks it."""
    d, s = F.trim(F.coalesce(description, F.lit(""))), F.trim(F.coalesce(source, F.lit("")))
    return F.when((s != "") & ~F.contains(d, s), F.concat_ws("\n", F.nullif(d, F.lit("")), F.concat(F.lit("Resolution source: "), s))).otherwise(F.coalesce(F.nullif(d, F.lit("")), s))


def official_tags(market: Column, slug) -> Column:
    """Slugs and labels of a market's tags, then those of its first two events with their categories, then its category; each once, in order."""
    named = lambda tags: F.flatten(F.transform(F.coalesce(tags, F.array().cast(f"array<{_OBJECT}>")), lambda t: F.array(t["slug"], t["label"])))
    tags = lambda x, path: named(F.from_json(_part(x, path), f"array<{_OBJECT}>"))
    events = F.slice(texts(_part(market, "$.events")), 1, 2)
    of_events = F.flatten(F.transform(events, lambda e: F.concat(tags(e, "$.tags"), F.array(_part(e, "$.category")))))
    every = F.concat(tags(market, "$.tags"), of_events, F.array(_part(market, "$.category")))
    return F.array_distinct(F.transform(F.filter(every, lambda t: F.coalesce(t, F.lit("")) != ""), lambda t: slug(t)))


def listing_rows(payload: Column) -> Column:
    """The data of a listing's children, as JSON; children without an object of data go."""
    children = texts(_part(payload, "$.data.children"))
    return F.filter(F.transform(children, lambda c: _part(c, "$.data")), lambda d: F.coalesce(d.startswith("{"), F.lit(False)))


def listing_after(payload: Column) -> Column:
    return _part(payload, "$.data.after")


def archive_posts(payload: Column) -> Column:
    """Posts of a page of an archive, as JSON: the list itself, or the posts or items of an object."""
    p = F.trim(payload)
    return F.when(p.startswith("["), texts(p)).otherwise(texts(_some(F.nullif(_part(p, "$.posts"), F.lit("[]")), _part(p, "$.items"))))


def link_href(item: Column, name: str) -> Column:
    return _part(item, f"$._links.{name}.href")


def mime(item: Column, linked_format: Column | None = None) -> Column:
    """A file's media type, lower-cased: its own, that of its format, or that of the format it links to (a payload that was fetched for it); else empty."""
    own = [_part(item, f"$.{k}") for k in ("mimeType", "mimetype", "mime", "type", "format.mimeType", "format.mimetype")]
    linked = [_part(linked_format, f"$.{k}") for k in ("mimeType", "mimetype")] if linked_format is not None else []
    return F.lower(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in own + linked], F.lit("")))


def is_object(x: Column) -> Column:
    return F.coalesce(F.trim(x).startswith("{") & F.get_json_object(x, "$").isNotNull(), F.lit(False))


def tool_payload(content: Column) -> Column:
    """A tool's answer as a JSON object: itself, other JSON as results, other text as raw_content; empty for none."""
    t = F.trim(F.coalesce(content, F.lit("")))
    whole = F.get_json_object(t, "$")
    return F.when(t == "", "{}").when(is_object(t), t).when(whole.isNotNull(), F.concat(F.lit('{"results":'), t, F.lit("}"))).otherwise(F.to_json(F.struct(t.alias("raw_content"))))


def listed_url(line: Column) -> Column:
    """The URL of a line of a list of URLs: of a JSON object its url, of other text the text; null for blank lines and for other JSON."""
    t = F.trim(line)
    return F.when(t == "", None).when(is_object(t), F.nullif(_part(t, "$.url"), F.lit(""))).when(F.get_json_object(t, "$").isNull(), t)


def listed_day(line: Column) -> Column:
    """When a listed URL was published, by the first key that says so; empty if none does."""
    return F.coalesce(_some(*[_part(line, f"$.{k}") for k in ("published_at", "gkg_date", "created_at", "create_at")]), F.lit(""))


def status_codes(x: Column) -> Column:
    """Codes from 100 to 599 of a comma-joined list, rising, each once."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda c: F.trim(c).try_cast("int")), lambda c: c.between(100, 599))))


def csv_list(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != "")


def message_text(content: Column) -> Column:
    """A message's text: the text, or the texts (else contents) of a JSON list of parts, a line each."""
    t = F.coalesce(content, F.lit(""))
    each = F.transform(texts(t), lambda p: _some(_part(p, "$.text"), _part(p, "$.content")))
    return F.when(F.trim(t).startswith("[") & (F.size(texts(t)) > 0), F.array_join(F.filter(each, lambda p: p.isNotNull()), "\n")).otherwise(t)


def tool_hits(payload: Column) -> Column:
    """Contents of a search tool's hits that aren't blank, trimmed."""
    return F.filter(F.transform(texts(_part(payload, "$.hits")), lambda h: F.trim(F.coalesce(_part(h, "$.content"), F.lit("")))), lambda c: c != "")


def trajectory_hits(payload: Column) -> Column:
    """content and source of each hit; a hit that is no object is its own content."""
    hit = lambda h: F.when(is_object(h), F.struct(_part(h, "$.content").alias("content"), _part(h, "$.source").alias("source"))).otherwise(F.struct(h.alias("content"), F.lit(None).cast("string").alias("source")))
    return F.transform(texts(_part(payload, "$.hits")), hit)

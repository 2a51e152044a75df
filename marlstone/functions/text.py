"""Text functions. All take and return Columns; null stays null unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import fixed


def clean(x: Column) -> Column:
    """Runs of any white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def clean_or_empty(x: Column) -> Column:
    return F.coalesce(clean(x), F.lit(""))


def key(x: Column) -> Column:
    return F.lower(clean(x))


def strip_control(x: Column) -> Column:
    """Without control characters, but for tab and line ends."""
    return F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def truncate(x: Column, n: int) -> Column:
    return F.rtrim(F.left(x, F.lit(n)))


def compact(x: Column, n: int) -> Column:
    """At most n characters, the last three of a longer text being dots."""
    t = clean(x)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(max(0, n - 3)))), F.lit("...")))


def is_sentence(x: Column) -> Column:
    return x.rlike("[.!?。！？]")


def is_heading(x: Column) -> Column:
    return x.rlike(r"^\s{0,3}#{1,6}\s+\S+")


def without_site(title: Column) -> Column:
    """A title without the site's name after a mark, if eight characters or more are left."""
    left = F.trim(F.get(F.split(title, r"\s+[|\-—–:]\s+", 2), F.lit(0)))
    return F.when(F.length(left) >= 8, left).otherwise(F.trim(title))


def inline(x: Column) -> Column:
    """Markdown images go, links become their texts, bare addresses go."""
    x = F.regexp_replace(x, r"!\[[^\]]*\]\([^)]*\)", " ")
    x = F.regexp_replace(x, r"\[([^\]]+)\]\([^)]*\)", "$1")
    x = F.regexp_replace(x, r"https?://\S+", " ")
    return clean(F.regexp_replace(x, r"\bwww\.\S+", " "))


def slug(x: Column, default: str = "other") -> Column:
    s = F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", F.lit(default)).otherwise(s)


def question_key(x: Column) -> Column:
    """What two wordings of one question have in common."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def task_shape(question: Column) -> Column:
    """A question without its deadline, at most 90 characters."""
    return F.trim(F.substring(clean(F.regexp_replace(question, r"(?i)\bby\s+[A-Z][a-z]+\s+\d{1,2}\b.*$", "")), 1, 90))


def uuid_of(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"([0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12})", 1), F.lit(""))


def failure_stage(reason: Column) -> Column:
    """connect, read, http or other, by the markers in what a failed fetch says of itself."""
    r = F.lower(F.trim(F.coalesce(reason, F.lit(""))))
    any_of = lambda words: reduce(lambda a, b: a | b, [r.contains(w) for w in words])
    return F.when(any_of(fixed.FAILED_CONNECT), "connect").when(any_of(fixed.FAILED_READ), "read").when(any_of(fixed.FAILED_HTTP), "http").otherwise("other")


def http_status(reason: Column) -> Column:
    return F.regexp_extract(F.coalesce(reason, F.lit("")), r"http_(\d{3})", 1).try_cast("int")


def redact(x: Column) -> Column:
    """User and password of an address become stars."""
    return F.regexp_replace(x, r"(?<=://)[^/@\s]+@", "***@")


def first_line(x: Column) -> Column:
    """First line that isn't blank."""
    return F.trim(F.get(F.filter(F.split(x, "\n"), lambda s: F.trim(s) != ""), F.lit(0)))


def title_from(content: Column) -> Column:
    return F.left(F.regexp_replace(first_line(content), r"^#+\s*", ""), F.lit(200))


def tokens(x: Column) -> Column:
    """Runs of ASCII letters, digits and underscores, lower-cased after they are found."""
    return F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower)


def lucene_tokens(x: Column, stop: list[str]) -> Column:
    """Words of two characters or more in any script, lower-cased first, without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def token_count(x: Column) -> Column:
    """About how many words a text has."""
    return F.size(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(?U)\w+"), F.lit(0)))


def record_id(*parts: Column) -> Column:
    """SHA-1 of the parts, joined; a missing one is empty, which concat_ws alone would skip."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def compose(title: Column, content: Column) -> Column:
    """A quoted title line and the content; just one of them if the other is empty."""
    t, c = F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))
    return F.when((t != "") & (c != ""), F.concat(F.lit('"'), t, F.lit('"\n'), c)).otherwise(F.concat(t, c))

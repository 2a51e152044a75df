"""Date and time functions. Nothing here fails on bad input unless it says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = r"^\d{4}-\d{2}-\d{2}$"
_STAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)?$"


def parse(x: Column) -> Column:
    """A timestamp in UTC of an ISO date or time; null for anything else. Without an offset a time is UTC."""
    t = F.trim(x)
    return F.when(t.rlike(_DAY) | t.rlike(_STAMP), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, " ", "T"), r"(:\d{2}(?:\.\d+)?)([+-]\d{2})$", "$1$2:00")))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day(x: Column) -> Column:
    return F.to_date(parse(x))


def day_strict(x: Column) -> Column:
    """The day of a text; an error if there is a text but no day in it."""
    return F.when(F.coalesce(F.trim(x), F.lit("")) == "", F.lit(None)).otherwise(F.coalesce(day(x), F.raise_error(F.concat(F.lit("not a day: "), x)).cast("date")))


def day_bounds(d: Column) -> tuple[Column, Column]:
    start = d.cast("timestamp")
    return start, start + F.expr("INTERVAL 86399 SECONDS")


def duration_days(start: Column, end: Column) -> Column:
    return F.greatest((F.unix_micros(end) - F.unix_micros(start)) / F.lit(8.64e10), F.lit(0.0))


def gkg_day(x: Column) -> Column:
    """Day of yyyyMMdd or yyyyMMddHHmmss; of another text of eight characters or more, the day that its first eight spell."""
    head = F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2))
    short = F.when(x.rlike(r"^\d{8}$"), F.try_to_date(x, "yyyyMMdd").cast("string"))
    long = F.when(x.rlike(r"^\d{14}$"), F.to_date(F.try_to_timestamp(x, F.lit("yyyyMMddHHmmss"))).cast("string"))
    return F.coalesce(short, long, F.when(F.length(x) >= 8, head))


def month(x: Column) -> Column:
    return F.coalesce(F.date_format(parse(x), "yyyy-MM"), F.nullif(F.left(F.trim(x), F.lit(7)), F.lit("")), F.lit("unknown"))


def rfc_2822(x: Column) -> Column:
    """Time of a feed's date; the name of the weekday is left out, as parsers reject it."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(x), r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))


def any_format(x: Column) -> Column:
    """ISO, or a month's name with day and year."""
    return F.coalesce(parse(x), F.try_to_timestamp(F.trim(x), F.lit("MMM d, yyyy")))

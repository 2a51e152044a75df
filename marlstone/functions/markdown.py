"""The body of Markdown texts, by functions of lines and arrays of lines.

What a rule needs to know about a line is found once and kept in a struct; later rules, those on neighbours included, look at structs only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import fixed
from marlstone.functions import text as X


def _has(low: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words; several times as fast as a pattern of them all."""
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def _hits(low: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in words])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _line(s: Column) -> Column:
    """What rules ask of a normalised line: s, low (lower-cased), sentence, n (its length)."""
    return F.struct(s.alias("s"), F.lower(s).alias("low"), X.is_sentence(s).alias("sentence"), F.length(s).alias("n"))


def _marked(z: Column) -> Column:
    """A line with what costs most to find out: interface (a word of one), noise, player."""
    return F.struct(*[z[c].alias(c) for c in ("s", "low", "sentence", "n")], _has(z["low"], fixed.INTERFACE).alias("interface"), _has(z["low"], fixed.INLINE_NOISE).alias("noise"), is_player(z).alias("player"))


def is_separator(line: Column) -> Column:
    return line.rlike(fixed.TABLE_SEPARATOR)


def maybe_table(line: Column) -> Column:
    """A separator, or a line of two bars or more and two cells or more that aren't empty."""
    bars = F.length(line) - F.length(F.translate(line, "|", ""))
    return F.contains(line, F.lit("|")) & (is_separator(line) | ((bars >= 2) & (F.size(F.filter(F.split(line, r"\|"), lambda c: F.trim(c) != "")) >= 2)))


def is_player(z: Column) -> Column:
    """A line of a player's or a caption menu's interface."""
    percents = F.when(F.contains(z["s"], F.lit("%")), F.size(F.regexp_extract_all(z["s"], F.lit(r"\b\d{1,3}%(?=\w)"), F.lit(0)))).otherwise(0)
    hits, colors = _hits(z["low"], fixed.INTERFACE), _hits(z["low"], fixed.COLORS)
    long = F.when(~z["sentence"] & (z["n"] >= 90), (hits >= 4) | ((hits >= 3) & (colors >= 3))).otherwise(False)
    glued = F.when(_has(z["low"], ["text", "opacity", "font", "caption"]), z["s"].rlike(fixed.GLUED)).otherwise(False)
    return glued | long | (~z["sentence"] & (percents >= 2) & z["low"].rlike("font|opacity"))


def is_navigation(z: Column) -> Column:
    """Items of lists, short clusters with bars, and up to three words without a sentence."""
    words = F.when(z["n"] <= 30, F.size(F.regexp_extract_all(z["s"], F.lit(fixed.WORDLIKE), F.lit(0)))).otherwise(0)
    return z["s"].rlike(r"^([-*•]|\d+\.)\s+\S") | (~z["sentence"] & F.contains(z["s"], F.lit("|")) & (z["n"] < 260)) | (~z["sentence"] & words.between(1, 3))


def is_short(z: Column) -> Column:
    return F.when(z["sentence"], z["n"] < 60).otherwise(z["n"] < 80)


def is_body(z: Column) -> Column:
    """A paragraph: long enough, of words, with a sentence, and no cluster of links."""
    n = lambda pattern: F.size(F.regexp_extract_all(z["s"], F.lit(pattern), F.lit(0)))
    enough = (z["n"] >= 60) & (z["sentence"] | (z["n"] >= 600))
    return F.when(enough, (n(fixed.WORDLIKE) >= 10) & (n(r"\b\d+\.\s") < 2) & (z["sentence"] | (n(r"\s[*•]\s") < 2)) & ~z["noise"] & ~z["player"]).otherwise(False)


def _told(z: Column) -> Column:
    """s, blank, table, separator, kept (the line passes the strict filter), body (it is a paragraph)."""
    interface = z["player"] | (z["interface"] & ~(z["sentence"] & (z["n"] >= 100))) | z["s"].rlike(fixed.SEE_ALL)
    noise = z["noise"] & ~(z["sentence"] & (z["n"] >= 120))
    table = maybe_table(z["s"])
    kept = (z["s"] == "") | (F.when(table, True).otherwise(~is_short(z) & ~noise & ~is_navigation(z)) & ~interface)
    return F.struct(z["s"].alias("s"), (z["s"] == "").alias("blank"), table.alias("table"), is_separator(z["s"]).alias("separator"), kept.alias("kept"), F.when(z["n"] >= 60, is_body(z)).otherwise(False).alias("body"))


def _in_table(lines: Column, i: Column) -> Column:
    """Whether the possible table line i is one, by its neighbours."""
    at = lambda d, what: F.when(i + d >= 0, F.coalesce(F.get(lines, i + d)[what], F.lit(False))).otherwise(False)
    both = at(-1, "table") & at(1, "table")
    return at(0, "separator") | at(-1, "separator") | at(1, "separator") | both | (at(-1, "table") & at(-2, "separator")) | (at(1, "table") & at(2, "separator"))


def body(x: Column) -> Column:
    """Lines of the body and of tables, without headings, lists, interfaces and what is short. Null and empty texts are empty."""
    raw = F.split(F.coalesce(x, F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")
    # A line that only control characters make up goes; one that is blank separates.
    lines = F.filter(F.transform(raw, lambda s: F.struct(s.alias("raw"), X.clean(X.strip_control(s)).alias("s"))), lambda z: (~X.is_heading(F.trim(z["raw"]))) & ((z["s"] != "") | (X.clean(z["raw"]) == "")))
    told = F.filter(F.transform(F.transform(F.transform(lines, lambda z: _line(z["s"])), _marked), _told), lambda z: z["kept"])
    single = _let(told, lambda a: F.filter(a, lambda z, i: ~(z["blank"] & F.when(i > 0, F.coalesce(F.get(a, i - 1)["blank"], F.lit(False))).otherwise(False))))
    chosen = _let(single, lambda a: F.filter(F.transform(a, lambda z, i: F.when(~z["blank"] & F.when(z["table"] & _in_table(a, i), True).otherwise(z["body"]), z["s"])), lambda s: s.isNotNull()))
    return F.array_join(chosen, "\n")


def long_lines(x: Column, least: int = 100) -> Column:
    """Lines of so many characters and headings, but for headings that nothing follows."""
    some = F.filter(F.split(F.coalesce(x, F.lit("")), "\n"), lambda s: (F.length(F.trim(s)) >= least) | F.trim(s).startswith("#"))
    cut = lambda a: F.slice(a, 1, F.coalesce(F.array_max(F.transform(a, lambda s, i: F.when(~F.trim(s).startswith("#"), i + 1).otherwise(F.lit(0)))), F.lit(0)))
    return F.array_join(_let(some, cut), "\n")


def reader_text(x: Column) -> Column:
    """What follows a reader service's heading, or all."""
    return F.trim(F.coalesce(F.get(F.split(x, "Markdown Content:", 2), F.lit(1)), x))

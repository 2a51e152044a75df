"""Texts that are shown to a model: questions, documents, memories and trajectories, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions.values import last_items


def _labelled(label: str, x: Column) -> Column:
    """A line, or null if there is nothing to say."""
    return F.concat(F.lit(f"{label}: "), F.nullif(F.trim(F.coalesce(x, F.lit(""))), F.lit("")))


def search_query(question: Column, description: Column, domain: Column, n: int = 400) -> Column:
    """What to search for: the question, the first line of its description, its domain."""
    return F.left(X.clean(F.concat_ws(" ", question, X.first_line(description), domain)), F.lit(n))


def memory_query(question: Column, description: Column, domain: Column) -> Column:
    return F.concat_ws(" ", question, F.left(F.coalesce(description, F.lit("")), F.lit(300)), domain)


def question_block(question: Column, description: Column, criteria: Column, domain: Column, n: int = 900) -> Column:
    """The question with its description and criteria, which are left out if they only repeat the description."""
    own = F.when(F.coalesce(X.key(criteria), F.lit("")) != F.coalesce(X.key(description), F.lit("")), criteria)
    return F.concat_ws("\n", _labelled("Question", question), _labelled("Domain", domain), _labelled("Description", X.compact(description, n)), _labelled("Resolution criteria", X.compact(own, n)))


def documents(hits: Column, n: int = 800) -> Column:
    """Numbered documents of an array of hits (title, source, timestamp, content)."""
    one = lambda h, i: F.concat_ws("\n", F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.concat_ws(" | ", h["title"], h["source"], h["timestamp"].cast("string"))), X.compact(h["content"], n))
    return F.array_join(F.transform(hits, one), "\n\n")


def memories(items: Column) -> Column:
    """Numbered memories of an array (title, description, content)."""
    one = lambda m, i: F.concat_ws("\n", F.concat(F.lit("Memory "), (i + 1).cast("string"), F.lit(": "), m["title"]), m["description"], m["content"])
    return F.array_join(F.transform(items, one), "\n\n")


def experiences(items: Column) -> Column:
    """Experiences of an array (level, zone, title, summary, content)."""
    one = lambda m: F.concat(F.lit("- ["), m["level"], F.lit("/"), m["zone"], F.lit("] "), m["title"], F.lit(": "), X.compact(F.concat_ws(" ", m["summary"], m["content"]), 600))
    return F.array_join(F.transform(items, one), "\n")


def trajectory(steps: Column, n: int = 10, most: int = 300) -> Column:
    """The last steps of an array (tool, arguments, result), a line each."""
    one = lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(s["tool"], F.lit("answer")), F.lit("("), X.compact(F.coalesce(s["arguments"], F.lit("")), 120), F.lit(") -> "), X.compact(F.coalesce(s["result"], F.lit("")), most))
    return F.array_join(F.transform(last_items(steps, n), one), "\n")


def source_type(hit_type: Column, source: Column) -> Column:
    """A hit's type: the field, else what follows the mark in its source, else unknown."""
    return F.coalesce(F.nullif(F.trim(hit_type), F.lit("")), F.nullif(F.split_part(source, F.lit("/"), F.lit(2)), F.lit("")), F.lit("unknown"))


def agent_system(method: str, has_memories: Column, has_experiences: Column) -> Column:
    """Sections of an agent's instructions, those on memories only where there are some."""
    return F.concat_ws("\n\n", F.lit(f"You forecast the probability that a question resolves YES. Method: {method}."), F.when(has_memories, F.lit("Use the memories below where they fit the question.")), F.when(has_experiences, F.lit("Weigh experiences of the warning zone as mistakes to avoid.")))

"""What solved questions leave behind: experiences of three levels, and the texts that stand in where a model gives none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as X

#: Titles by level, for right and for wrong forecasts.
TITLES = {
    "strategy": ("Prioritize task-specific evidence before base-rate extrapolation", "Do not confuse missing confirmation with low event probability"),
    "pattern": ("Sequence targeted evidence checks before numeric estimation", "Stop broad search when results stay off-topic and switch approach"),
}
#: Contents for right and for wrong forecasts.
CONTENTS = ("Preserve the successful evidence-weighting pattern and reuse it on similar questions.", "Preserve this warning so similar questions avoid repeating the same mistake.")
MEMORY_CONTENTS = ("Use cutoff-safe evidence, update from concrete signals, and finish with explicit uncertainty.", "Record which cues were over- or under-weighted and avoid repeating the same mistake.")
#: Titles that say nothing.
GENERIC = ["golden strategy", "golden pattern", "golden case", "warning strategy", "warning pattern", "warning case", "case note"]
LEVELS = ["strategy", "pattern", "case"]


def is_right(p: Column, label: Column) -> Column:
    """Whether a probability is on the label's side; a missing one counts as one half."""
    return (F.coalesce(p, F.lit(0.5)) >= 0.5) == (label > 0)


def zone(right: Column) -> Column:
    return F.when(right, "golden").otherwise("warning")


def task_shape(question: Column, domain: Column) -> Column:
    """A question without its deadline and its marks, at most 90 characters."""
    t = F.regexp_replace(X.clean_or_empty(question), r"(?i)\bby\s+[A-Z][a-z]+\s+\d{1,2}\b.*$", "")
    return F.coalesce(F.nullif(F.left(F.trim(X.clean(t), F.lit(" ?")), F.lit(90)), F.lit("")), F.concat(domain, F.lit(" forecasting case")))


def default_title(level: str, right: Column, question: Column, domain: Column) -> Column:
    if level in TITLES:
        return F.when(right, TITLES[level][0]).otherwise(TITLES[level][1])
    return task_shape(question, domain)


def default_summary(level: str, zone_: Column, domain: Column) -> Column:
    return F.concat(zone_, F.lit(f" {level} distilled from a resolved "), domain, F.lit(" forecasting example."))


def default_content(reasoning: Column, zone_: Column) -> Column:
    return F.coalesce(F.nullif(X.clean(reasoning), F.lit("")), F.when(zone_ == "golden", CONTENTS[0]).otherwise(CONTENTS[1]))


def is_generic_title(x: Column) -> Column:
    t = F.lower(X.clean_or_empty(x))
    return t.isin(GENERIC) | t.endswith("case note")


def memory_item(p: Column, label: Column, domain: Column, reasoning: Column) -> Column:
    """title, description and content of a forecast, for a store without levels."""
    right, outcome = is_right(F.nullif(p, F.lit(0.0)), label), F.when(label > 0, "YES").otherwise("NO")
    told = F.nullif(X.clean(reasoning), F.lit(""))
    return F.struct(
        F.concat(domain, F.when(right, " successful reasoning pattern").otherwise(" failure warning")).alias("title"),
        F.concat(F.lit("Resolved "), outcome, F.when(right, " correctly using reusable reasoning cues.").otherwise("; preserve this as a warning for similar tasks.")).alias("description"),
        F.coalesce(told, F.when(right, MEMORY_CONTENTS[0]).otherwise(MEMORY_CONTENTS[1])).alias("content"),
    )


def experiences(results: DataFrame) -> DataFrame:
    """Three experiences, one of each level, of every result: market_id, domain, question, open_time, resolve_time, label, predicted_prob, reasoning_summary."""
    right = is_right(F.col("predicted_prob"), F.col("label"))
    kind = zone(right)

    def one(level: str) -> Column:
        return F.struct(
            F.concat(F.lit("flex-"), kind, F.lit(f"-{level}-"), F.col("market_id").cast("string")).alias("experience_id"), F.col("market_id").alias("source_question_id"), F.col("domain"), kind.alias("zone"),
            F.lit(level).alias("level"), default_title(level, right, F.col("question"), F.col("domain")).alias("title"), default_summary(level, kind, F.col("domain")).alias("summary"),
            default_content(F.col("reasoning_summary"), kind).alias("content"), F.col("resolve_time").alias("created_at"), F.col("open_time").alias("source_open_time"),
            F.col("resolve_time").alias("source_resolved_time"), F.col("label").alias("outcome"), right.alias("correctness"), F.lit(1).cast("bigint").alias("support_count"),
        )

    return results.select(F.inline(F.array(*map(one, LEVELS))))

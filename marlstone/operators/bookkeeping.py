"""Books of a crawl or a harvest: days to fetch, what succeeded, what failed and why, totals of runs and of token use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """day: every day from first to last, both included; none if last is before first."""
    span = F.when(F.to_date(F.lit(first)) <= F.to_date(F.lit(last)), F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).otherwise(F.array().cast("array<date>"))
    return spark.range(1).select(F.explode(span).alias("day"))


def days_to_fetch(spark: SparkSession, first: str, last: str, files: DataFrame, name: str = "name") -> DataFrame:
    """Days whose file (its name begins with yyyyMMdd) isn't there yet."""
    have = files.select(F.to_date(F.nullif(F.regexp_extract(F.col(name), r"^(\d{8})", 1), F.lit("")), "yyyyMMdd").alias("day"))
    return days(spark, first, last).join(have, "day", "left_anti")


def pending(pool: DataFrame, limit: int | None = None) -> DataFrame:
    """URLs of a pool that are pending, with the day of their source, or else that of their row, as created_at."""
    rows = pool.filter((F.col("status") == "pending") & (F.coalesce("url", F.lit("")) != ""))
    rows = rows.select("url", F.coalesce(F.nullif("gkg_date", F.lit("")), F.col("created_at")).alias("created_at"), "themes")
    return rows.limit(limit) if limit else rows


def with_meta(rows: DataFrame, meta: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows with columns of the first row (by all columns, in order) that meta has for their key; empty text where there is none."""
    one = meta.groupBy(key).agg(F.min(F.struct(*columns)).alias("_m"))
    return rows.join(one, key, "left").select(*rows.columns, *[F.coalesce(F.col("_m")[c], F.lit("")).alias(c) for c in columns])


def fetch_outcomes(asked: DataFrame, attempts: DataFrame, url: str = "url", order: str = "attempt", ok: str = "ok", reason: str = "reason") -> DataFrame:
    """url, status (success or failed), reason (of the last failure that gave one, else unknown_failure; null for successes) of each asked URL that isn't blank. One success is enough."""
    urls = asked.select(F.trim(F.col(url).cast("string")).alias("url")).filter("url <> ''").distinct()
    why = F.nullif(F.left(F.trim(F.regexp_replace(F.coalesce(F.col(reason), F.lit("")), r"\s+", " ")), F.lit(240)), F.lit(""))
    seen = attempts.select(F.trim(F.col(url)).alias("url"), F.col(order).alias("o"), F.col(ok).alias("ok"), why.alias("why"))
    by = seen.groupBy("url").agg(F.bool_or("ok").alias("ok"), F.max_by("why", F.when(~F.col("ok") & F.col("why").isNotNull(), F.col("o"))).alias("last"), F.max(F.when(~F.col("ok") & F.col("why").isNotNull(), F.col("o"))).alias("any"))
    won = F.coalesce("ok", F.lit(False))
    return urls.join(by, "url", "left").select("url", F.when(won, "success").otherwise("failed").alias("status"), F.when(~won, F.coalesce(F.when(F.col("any").isNotNull(), F.col("last")), F.lit("unknown_failure"))).alias("reason"))


def by_reason(outcomes: DataFrame, default: str = "crawl_failed") -> DataFrame:
    """reason, n: how many URLs failed for each reason, as a status update would be grouped."""
    failed = outcomes.filter("status = 'failed'")
    return failed.groupBy(F.coalesce(F.nullif("reason", F.lit("")), F.lit(default)).alias("reason")).agg(F.count("*").alias("n"))


def reasons_text(outcomes: DataFrame, k: int = 3) -> DataFrame:
    """One row, summary: the k most frequent reasons as `reason xN`, ties by name; `none` if nothing failed."""
    top = by_reason(outcomes, "unknown_failure").orderBy(F.col("n").desc(), "reason").limit(k)
    each = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "reason"))).alias("a"))  # k at most
    return each.select(F.when(F.size("a") == 0, "none").otherwise(F.array_join(F.transform("a", lambda x: F.concat(x["reason"], F.lit(" x"), (-x["m"]).cast("string"))), "; ")).alias("summary"))


def recovered(pool: DataFrame, output: DataFrame, url: str = "url") -> DataFrame:
    """The pool with status success for what the output has already."""
    have = output.select(F.col(url).alias("_u")).distinct()
    return pool.join(have, F.col(url) == F.col("_u"), "left").select(*[F.when(F.col("_u").isNotNull(), "success").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in pool.columns])


def totals(df: DataFrame, by: str, *numbers: str) -> DataFrame:
    """by and the sums of the numbers (missing ones are 0), and one row `total`."""
    rows = df.rollup(by).agg(*[F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in numbers], F.grouping(by).alias("_g"))
    return rows.select(F.when(F.col("_g") == 1, "total").otherwise(F.coalesce(F.col(by).cast("string"), F.lit("unknown"))).alias(by), *numbers)


def last_message(messages: DataFrame, conv: str, turn: str, role: str, text: str, who: str = "assistant") -> DataFrame:
    """conv and the text of the last message of that role; conversations without one have empty text."""
    mine = F.when(F.col(role) == who, F.col(turn))
    rows = messages.groupBy(conv).agg(F.max_by(F.coalesce(F.col(text), F.lit("")), mine).alias("t"), F.max(mine).alias("any"))
    return rows.select(conv, F.when(F.col("any").isNotNull(), F.col("t")).otherwise("").alias("final"))


def sampled(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement: those of the smallest hash of key and seed."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def with_previous(df: DataFrame, by: list[str], order: list[Column], value: str) -> DataFrame:
    return df.withColumn("previous", F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))

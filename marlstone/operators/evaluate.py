"""Calibration and summaries of forecasts, and the statistics of corpora and pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import values as V


def bin_of(p: Column, bins: int) -> Column:
    """Bin i holds i/bins <= p < (i+1)/bins, by comparison and not by a product; the last holds 1 as well."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(bins - 1)), F.lit(0), lambda s, i: F.when(p >= i / F.lit(float(bins)), i).otherwise(s))


def calibration(df: DataFrame, p: str, label: str, bins: int = 10, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, bin, lower, upper, count, avg_pred, avg_label, gap for every bin that isn't empty."""
    rows = df.withColumn("bin", bin_of(F.col(p), bins)).groupBy(*by, "bin").agg(F.count("*").alias("count"), F.avg(p).alias("avg_pred"), F.avg(label).alias("avg_label"))
    return rows.withColumn("lower", F.col("bin") / F.lit(float(bins))).withColumn("upper", (F.col("bin") + 1) / F.lit(float(bins))).withColumn("gap", F.abs(F.col("avg_pred") - F.col("avg_label")))


def ece(df: DataFrame, p: str, label: str, bins: int = 10, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, ece: gaps weighted by the bins' shares; 0 for no rows at all."""
    out = calibration(df, p, label, bins, by).groupBy(*by).agg((F.sum(F.col("count") * F.col("gap")) / F.sum("count")).alias("ece"))
    return out if by else out.select(F.coalesce("ece", F.lit(0.0)).alias("ece"))


def summary(results: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """by, n, accuracy, brier, ece, latency, tokens, steps (means of those that aren't null) and their coverage."""
    rows = results.withColumn("_p", V.clamp(F.col("predicted_prob")))
    means = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(((F.col("_p") >= 0.5).cast("int") == F.col("label")).cast("double")).alias("accuracy"), F.avg(V.brier(F.col("_p"), F.col("label"))).alias("brier"),
        F.avg("latency_sec").alias("latency"), F.avg("total_tokens").alias("tokens"), F.avg("steps_count").alias("steps"),
        (F.count("total_tokens") / F.count("*")).alias("tokens_coverage"), (F.count("steps_count") / F.count("*")).alias("steps_coverage"),
    )
    errors = ece(rows, "_p", "label", bins, by)
    return means.join(errors, by) if by else means.crossJoin(F.broadcast(errors))


def ranking(summaries: DataFrame) -> DataFrame:
    """Best first: by Brier score, then calibration error, then accuracy."""
    return summaries.orderBy("brier", "ece", F.col("accuracy").desc())


def render(rows: list, name: str = "method") -> str:
    """A Markdown table of summaries."""
    head = f"| {name} | accuracy | Brier | ECE | latency | tokens | steps |\n|---|---|---|---|---|---|---|"
    show = lambda x, f: "-" if x is None else format(x, f)
    return "\n".join([head, *(f"| {r[name]} | {r['accuracy']:.3f} | {r['brier']:.4f} | {r['ece']:.4f} | {show(r['latency'], '.2f')} | {show(r['tokens'], '.0f')} | {show(r['steps'], '.1f')} |" for r in rows)])


def results(df: DataFrame) -> DataFrame:
    """Clamps probabilities and adds brier_score; a failed forecast counts as one half."""
    p = F.when(F.col("error").isNotNull(), F.lit(0.5)).otherwise(V.clamp(F.coalesce("predicted_prob", F.lit(0.5))))
    return df.withColumn("predicted_prob", p).withColumn("brier_score", V.brier(p, F.col("label")))


def counts_with_total(df: DataFrame, by: str) -> DataFrame:
    """by, count, and one row `total`."""
    return df.rollup(by).agg(F.count("*").alias("count"), F.grouping(by).alias("_g")).select(F.when(F.col("_g") == 1, "total").otherwise(F.coalesce(F.col(by), F.lit("unknown"))).alias(by), "count")


def corpus_stats(passages: DataFrame) -> DataFrame:
    """source, documents, passages, and a row `total` over all sources."""
    rows = passages.rollup("source").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("passages"), F.grouping("source").alias("_g"))
    return rows.select(F.when(F.col("_g") == 1, "total").otherwise(F.coalesce("source", F.lit("unknown"))).alias("source"), "documents", "passages")


def subject_stats(df: DataFrame, month: Column, subjects: Column, tokens: Column) -> DataFrame:
    """dimension (month or subject), value, count, tokens, avg_tokens: a record counts for each of its subjects."""
    rows = df.select(month.alias("month"), subjects.alias("subjects"), tokens.alias("tokens"))
    one = rows.select(F.lit("month").alias("dimension"), F.col("month").alias("value"), "tokens")
    two = rows.select(F.lit("subject").alias("dimension"), F.explode("subjects").alias("value"), "tokens")
    return one.unionByName(two).groupBy("dimension", "value").agg(F.count("*").alias("count"), F.sum("tokens").alias("tokens"), F.round(F.avg("tokens"), 2).alias("avg_tokens"))


def availability(df: DataFrame, horizon: str, domain: str, difficulty: str) -> DataFrame:
    """Counts by (horizon, domain) and by (horizon, difficulty) in one pass."""
    return df.groupingSets([[horizon, domain], [horizon, difficulty]], horizon, domain, difficulty).agg(F.count("*").alias("count"))


def reject_reasons(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds reject_reason: the first rule that a row breaks, null if it breaks none."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(True)), F.lit(name)).otherwise(out)
    return df.withColumn("reject_reason", out)


def panel_status(panels: DataFrame, horizon: str, domain: str, least: int, least_domain: int, ratio: float) -> DataFrame:
    """horizon, size, active_domains (those with least_domain rows), domain_ratio (largest to smallest active), ok."""
    by = panels.groupBy(horizon, domain).agg(F.count("*").alias("n"))
    active = F.col("n") >= least_domain
    out = by.groupBy(horizon).agg(F.sum("n").alias("size"), F.count_if(active).alias("active_domains"), (F.max(F.when(active, F.col("n"))) / F.min(F.when(active, F.col("n")))).alias("domain_ratio"))
    return out.withColumn("ok", (F.col("size") >= least) & ((F.col("active_domains") < 2) | (F.coalesce("domain_ratio", F.lit(1.0)) <= ratio)))


def horizon_status(markets: DataFrame, sampled: str, horizons: list[str]) -> DataFrame:
    """horizon, covered, missing: how many markets have a sample in the map at each horizon."""
    each = F.explode(F.array(*map(F.lit, horizons))).alias("horizon")
    rows = markets.select(each, F.col(sampled).alias("_m")).withColumn("_has", F.col("_m")[F.col("horizon")].isNotNull())
    return rows.groupBy("horizon").agg(F.count_if(F.col("_has")).alias("covered"), F.count_if(~F.coalesce("_has", F.lit(False))).alias("missing"))


def top_reasons(df: DataFrame, reason: str, k: int = 10) -> DataFrame:
    """The k most frequent reasons, ties by name."""
    return df.filter(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), reason).limit(k)


def add_optional(a: Column, b: Column) -> Column:
    """Sum of two numbers that may be missing; null only if both are."""
    return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))

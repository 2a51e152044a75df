"""Numbers, vectors, probabilities and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_float(x: Column) -> Column:
    return F.trim(x.cast("string")).try_cast("double")


def to_int(x: Column) -> Column:
    """Whole numbers; fractions are cut towards zero."""
    return to_float(x).try_cast("bigint")


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 for vectors of unequal length or none."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def unit(v: Column) -> Column:
    """A vector of length 1 in the same direction; the null vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def clamp(p: Column) -> Column:
    """From 0 to 1; null stays null."""
    return F.when(p < 0, F.lit(0.0)).when(p > 1, F.lit(1.0)).otherwise(p)


def probability(x: Column) -> Column:
    """A number from 0 to 1 as it is, one up to 100 or with a percent sign by the hundred; null for others."""
    t = F.trim(x.cast("string"))
    value = F.regexp_replace(t, r"\s*%$", "").try_cast("double")
    return let(F.struct(t.endswith("%").alias("percent"), value.alias("v")), lambda r: F.when(r["percent"] & r["v"].between(0, 100), r["v"] / 100).when(r["v"].between(0, 1), r["v"]).when((r["v"] > 1) & (r["v"] <= 100), r["v"] / 100))


def stated_probability(text: Column) -> Column:
    """Probability in a text that names it, as "predicted_prob": 0.7 or probability = 70%."""
    found = F.regexp_extract(text, r"(?i)[\"']?(?:predicted_prob|predicted_probability|probability|prob_yes)[\"']?\s*[:=]\s*[\"']?(-?[0-9]+(?:\.[0-9]+)?\s*%?)", 1)
    return probability(F.nullif(found, F.lit("")))


def fenced_json(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, r"(?si)```json(.*?)(```|\z)", 1)), F.lit(""))


def first_object(text: Column) -> Column:
    """The text from the first brace on; a parser tells whether it holds an object."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def let(x: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def json_object(text: Column) -> Column:
    """The JSON object of a text: itself, a fenced block, or what stands between braces; a variant, or null."""
    parsed = [let(F.try_parse_json(c), lambda p: F.when(F.schema_of_variant(p).startswith("OBJECT"), p)) for c in (text, fenced_json(text), first_object(text))]
    return F.coalesce(*parsed)


def forecast_probability(text: Column) -> Column:
    """From the object's keys, else from what the text names."""
    named = ("predicted_prob", "predicted_probability", "probability", "prob_yes")
    stated = let(json_object(text), lambda o: let(F.coalesce(*[F.try_variant_get(o, f"$.{k}", "string") for k in named]), probability))
    return clamp(F.coalesce(stated, stated_probability(text)))


def brier(p: Column, label: Column) -> Column:
    return F.pow(clamp(p) - label, F.lit(2.0))


def is_correct(p: Column, label: Column, compat: bool = False) -> Column:
    """Whether the likelier outcome came; compat reads a probability of exactly 0 as one half, as an or-default would."""
    p = F.coalesce(p, F.lit(0.5))
    p = F.when(p == 0, F.lit(0.5)).otherwise(p) if compat else p
    return (p >= 0.5).cast("int") == label


def difficulty(p: Column, volatility: Column) -> Column:
    """hard, medium or easy: the nearer to one half and the more it moves, the harder."""
    score = 0.6 * (1 - 2 * F.abs(p - 0.5)) + 0.4 * F.least(volatility / 0.05, F.lit(1.0))
    return F.when(score >= 0.58, "hard").when(score >= 0.30, "medium").otherwise("easy")


def last_items(a: Column, n: int) -> Column:
    """The last n of an array, or all."""
    return F.when(F.size(a) <= n, a).otherwise(F.slice(a, -n, n))


def cache_key(function: Column, params: Column) -> Column:
    """Hash of a name and a map, whatever the order of its keys."""
    return F.sha2(F.concat_ws("|", function, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))), 256)

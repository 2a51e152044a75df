"""A question set from prediction markets: admission, series, samples, balanced selection."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions import times as D
from marlstone.functions import values as V
from marlstone.operators import evaluate, series

OFFSETS = (30, 7, 1)


def is_binary(outcomes: Column) -> Column:
    return (F.size(outcomes) == 2) & F.forall(outcomes, lambda o: F.trim(o) != "")


def is_resolved(status: Column, closed: Column, prices: Column) -> Column:
    """Said to be resolved, or closed with one price near 1 and the other near 0."""
    far = (F.size(prices) == 2) & (F.array_max(prices) >= 0.95) & (F.array_min(prices) <= 0.05)
    return F.coalesce(F.lower(status) == "resolved", F.lit(False)) | (F.coalesce(closed, F.lit(False)) & F.coalesce(far, F.lit(False)))


def answer(prices: Column) -> Column:
    return F.when(F.size(prices) == 2, (F.get(prices, F.lit(0)) >= F.get(prices, F.lit(1))).cast("int"))


def domain_of(tags: Column, priority: dict[str, list[str]], generic: list[str]) -> Column:
    """The first domain in order of priority that a tag belongs to, else the first tag that isn't generic, else other."""
    own = F.get(F.filter(tags, lambda t: ~t.isin(generic) if generic else F.lit(True)), F.lit(0))
    out = F.coalesce(X.slug(own), F.lit("other"))
    for name, words in reversed(priority.items()):
        out = F.when(F.arrays_overlap(tags, F.array(*map(F.lit, words))), F.lit(name)).otherwise(out)
    return out


def admitted(markets: DataFrame, least_days: float = 1.0) -> DataFrame:
    """Adds reject_reason: what keeps a market (outcomes, prices, status, closed, question, open_time, resolve_time) out; null for none."""
    start, end = D.parse(F.col("open_time")), D.parse(F.col("resolve_time"))
    rules = [
        ("not_binary", ~is_binary(F.col("outcomes"))), ("not_resolved", ~is_resolved(F.col("status"), F.col("closed"), F.col("prices"))), ("no_question", F.trim("question") == ""),
        ("no_time", start.isNull() | end.isNull()), ("too_short", D.duration_days(start, end) < least_days),
    ]
    return evaluate.reject_reasons(markets, rules)


def samples(markets: DataFrame, prices: DataFrame, offsets: tuple[int, ...] = OFFSETS) -> DataFrame:
    """market_id, horizon, p_yes, difficulty: the price at the resolve time less each offset, where there is one.

    markets: market_id, resolve_ts, final; prices: market_id, t, p, pos. A day's last listed price counts; a market without prices has its final one.
    """
    daily = series.daily_last(prices, "market_id", "t", "p", "pos")
    daily = series.with_default(daily, markets, "market_id", F.to_date("resolve_ts"), F.col("final"))
    daily = series.volatility(daily, "market_id", "day", "p").select("market_id", F.col("day").cast("timestamp").alias("t"), F.struct("p", "volatility").alias("v"))
    targets = markets.select("market_id", "resolve_ts", F.explode(F.array(*map(F.lit, offsets))).alias("offset")).withColumn("target", F.col("resolve_ts") - F.make_dt_interval("offset"))
    at = series.as_of(daily, targets, "market_id", "t", "v", "target", series.forward_tolerance(F.col("offset"))).filter("value is not null")
    return at.select("market_id", F.concat(F.col("offset").cast("string"), F.lit("d")).alias("horizon"), F.col("value.p").alias("p_yes"), V.difficulty(F.col("value.p"), F.col("value.volatility")).alias("difficulty"))


@dataclass
class Targets:
    horizons: dict[str, int]
    domains: dict[str, dict[str, int]] = field(default_factory=dict)
    difficulties: dict[str, dict[str, int]] = field(default_factory=dict)
    whole: dict[str, int] = field(default_factory=dict)


#: Gains and penalties of one more market, by what is lacking or in excess.
GAIN = {"horizon": 1.4, "domain": 2.0, "domain_over": 0.9, "domain_none": 0.8, "difficulty": 1.1, "difficulty_over": 0.4, "whole": 2.4, "whole_over": 1.8, "whole_none": 1.2, "duplicate": 6.0}


def derive_targets(pool: dict[tuple, int], horizons: dict[str, int], size: int, slots: int = 8, least: int = 1) -> Targets:
    """Even shares: of each horizon for its largest domains and for its difficulties; of the whole for the largest domains, within their capacity."""
    by_domain: dict[str, Counter] = {h: Counter() for h in horizons}
    by_difficulty: dict[str, Counter] = {h: Counter() for h in horizons}
    whole: Counter = Counter()
    for (domain, sampled, _), n in pool.items():
        whole[domain] += n
        for h, d in sampled:
            if h in horizons:
                by_domain[h][domain] += n
                by_difficulty[h][d] += n
    share = lambda total, parts: -(-total // max(1, len(parts)))
    top = lambda c: [k for k, n in sorted(c.items(), key=lambda x: (-x[1], x[0])) if n >= least][:slots] or [k for k, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))][:slots]
    domains = {h: {d: share(horizons[h], top(c)) for d in top(c)} for h, c in by_domain.items()}
    difficulties = {h: {d: share(horizons[h], c) for d in c} for h, c in by_difficulty.items()}
    chosen = {d: whole[d] for d in top(whole)}
    from marlstone.operators.selection import water_fill

    return Targets(horizons, domains, difficulties, water_fill(chosen, size, 0))


def gain(signature: tuple, t: Targets, have: dict) -> float:
    domain, sampled, duplicate = signature
    out = 0.0
    for h, difficulty in sampled:
        if h not in t.horizons:
            continue
        out += GAIN["horizon"] * max(t.horizons[h] - have["h"][h], 0)
        want, now = t.domains.get(h, {}).get(domain, 0), have["hd"][h, domain]
        out += GAIN["domain"] * max(want - now, 0) - GAIN["domain_over"] * max(now - want, 0) if want else -GAIN["domain_none"]
        if want := t.difficulties.get(h, {}).get(difficulty, 0):
            now = have["hx"][h, difficulty]
            out += GAIN["difficulty"] * max(want - now, 0) - GAIN["difficulty_over"] * max(now - want, 0)
    want, now = t.whole.get(domain, 0), have["d"][domain]
    out += GAIN["whole"] * max(want - now, 0) - GAIN["whole_over"] * max(now - want, 0) if want else -GAIN["whole_none"]
    return out - GAIN["duplicate"] * duplicate


def choose(pool: dict[tuple, int], first: dict[tuple, int], t: Targets, size: int) -> Counter:
    """How many markets of each signature: one after the other by gain, ties to the signature whose first market comes first."""
    have, left, taken = {k: Counter() for k in ("h", "hd", "hx", "d")}, dict(pool), Counter()
    while left and sum(taken.values()) < size:
        s = max(left, key=lambda s: (round(gain(s, t, have), 9), -first[s]))
        taken[s] += 1
        left[s] -= 1
        if not left[s]:
            del left[s]
        have["d"][s[0]] += 1
        for h, x in s[1]:
            have["h"][h] += 1
            have["hd"][h, s[0]] += 1
            have["hx"][h, x] += 1
    return taken


def select(markets: DataFrame, sampled: DataFrame, horizons: dict[str, int], size: int) -> DataFrame:
    """`size` of the markets (market_id, domain, question), greedily balanced over horizons, domains and difficulties.

    A market counts by its signature: domain, difficulty at each horizon, and whether an earlier one asks the same. Only signatures
    and their counts come to the driver; of each, the markets of smallest id are taken.
    """
    order = Window.partitionBy("_key").orderBy("market_id")
    rows = markets.withColumn("_key", X.question_key(F.col("question"))).withColumn("_dup", (F.row_number().over(order) > 1).cast("int"))
    by = sampled.groupBy("market_id").agg(F.array_sort(F.collect_list(F.struct("horizon", "difficulty"))).alias("_s"))
    rows = rows.join(by, "market_id").withColumn("_sig", F.to_json(F.struct(F.col("domain").alias("d"), F.col("_s").alias("s"), F.col("_dup").alias("x"))))
    groups = rows.groupBy("_sig", "domain", "_s", "_dup").agg(F.count("*").alias("n"), F.min("market_id").alias("first")).collect()
    key = {r._sig: (r.domain, tuple((x.horizon, x.difficulty) for x in r._s), r._dup) for r in groups}
    ranks = {k: i for i, k in enumerate(sorted((key[r._sig] for r in groups), key=lambda k: next(str(r.first).zfill(20) for r in groups if key[r._sig] == k)))}
    pool = {key[r._sig]: r.n for r in groups}
    taken = choose(pool, ranks, derive_targets(pool, horizons, size), size)
    plan = [(s, taken[k]) for s, k in key.items() if taken[k]]
    if not plan:
        return markets.limit(0)
    met = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_sig").orderBy("market_id"))).join(F.broadcast(markets.sparkSession.createDataFrame(plan, "_sig string, _take long")), "_sig")
    return met.filter(F.col("_n") <= F.col("_take")).select(*markets.columns)


#: What a gap at a horizon (in days) counts; other horizons count 1.
DEFICIT_WEIGHTS = {30: 3.0, 7: 1.4, 1: 1.0}


def deficit_scores(candidates: DataFrame, counts: DataFrame, offsets: list[int], quota: int, domain: str = "domain", duration: str = "duration_days") -> DataFrame:
    """Candidates with deficit: over the horizons that they last for, how many questions their domain lacks there, weighted. counts has offset, domain and n; domains without a count lack all."""
    wide = counts.groupBy(F.col("domain").alias("_d")).agg(*[F.sum(F.when(F.col("offset") == d, F.col("n"))).alias(f"_n{d}") for d in offsets])
    gap = lambda d: F.greatest(F.lit(quota) - F.coalesce(f"_n{d}", F.lit(0)), F.lit(0)) * F.lit(DEFICIT_WEIGHTS.get(d, 1.0))
    score = sum((F.when(F.col(duration) >= d, gap(d)).otherwise(0.0) for d in offsets), F.lit(0.0))
    return candidates.join(wide, F.col(domain) == F.col("_d"), "left").select(*candidates.columns, score.alias("deficit"))


def next_batch(scored: DataFrame, n: int, key: str, duration: str = "duration_days", volume: str = "volume") -> DataFrame:
    """The n candidates of highest deficit, then duration, then volume, then smallest key; those of a positive deficit only, if there are any."""
    any_ = scored.agg(F.coalesce(F.max("deficit"), F.lit(0.0)).alias("_top"))
    rows = scored.crossJoin(F.broadcast(any_)).filter((F.col("deficit") > 0) | (F.col("_top") <= 0)).drop("_top")  # one row
    return rows.orderBy(F.col("deficit").desc(), F.col(duration).desc(), F.col(volume).desc(), key).limit(n)


def horizon_weights(offsets: list[int]) -> dict[int, float]:
    """Even for 30, 7 and 1 days; otherwise by the inverse root of the days."""
    if sorted(offsets) == [1, 7, 30]:
        return dict.fromkeys(offsets, 1 / 3)
    raw = {d: max(d, 1.0) ** -0.5 for d in offsets}
    return {d: x / (sum(raw.values()) or 1.0) for d, x in raw.items()}


def target_count(pool: int, least: int, most: int, ratio: float) -> int:
    """A share of the pool within bounds, no more than the pool."""
    return 0 if pool <= 0 else max(1, min(max(least, round(pool * ratio)), most, pool))


def horizon_targets(offsets: list[int], least: dict[int, int], total: int) -> dict[str, int]:
    return {f"{d}d": max(least.get(d, 0), round(total * w)) for d, w in horizon_weights(offsets).items()}


def subset_stats(subset: DataFrame, pool_size: int, dimensions: list[str], ranges: list[str]) -> DataFrame:
    """dimension, value, n: sizes of the subset and its pool, counts by each dimension, and first and last value (as n null) of each range."""
    size = subset.agg(F.count("*").alias("n")).select(F.lit("size").alias("dimension"), F.explode(F.array(F.struct(F.lit("selected").alias("value"), "n"), F.struct(F.lit("available").alias("value"), F.lit(pool_size).cast("bigint").alias("n")))).alias("x")).select("dimension", "x.*")
    out = size
    for d in dimensions:
        out = out.unionByName(subset.groupBy(F.col(d).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(d).alias("dimension"), "value", "n"))
    for r in ranges:
        ends = subset.agg(F.array(F.struct(F.lit(f"{r}:start").alias("dimension"), F.min(r).cast("string").alias("value")), F.struct(F.lit(f"{r}:end").alias("dimension"), F.max(r).cast("string").alias("value"))).alias("a"))
        out = out.unionByName(ends.select(F.inline("a")).select("dimension", F.coalesce("value", F.lit("")).alias("value"), F.lit(None).cast("bigint").alias("n")))
    return out


def check_manifest(ids: list, source_file: str | None) -> list[str]:
    """The ids of a fixed subset as texts; an error if there is no source, no id, an empty one or one that repeats."""
    out = [str(i).strip() for i in ids or []]
    if not (source_file or "").strip() or not out or "" in out or len(set(out)) < len(out):
        raise ValueError("a fixed subset needs a source file and ids, none of them empty or repeated")
    return out


def check_stats(expected: dict | None, actual: dict) -> None:
    """An error if the sizes and counts that a manifest tells aren't those found."""
    for k in ("selected_count", "domains", "difficulties"):
        if expected and k in expected and expected[k] != actual[k]:
            raise ValueError(f"{k}: {expected[k]!r} expected, {actual[k]!r} found")


def dominant_difficulty(sampled: Column) -> Column:
    """Of a map of horizons to samples the difficulty at 30, else 7, else 1 day, else at the first there is; unknown if there is none."""
    at = lambda h: F.when(F.map_contains_key(sampled, F.lit(h)), F.coalesce(sampled[h]["difficult"], F.lit("unknown")))
    first = F.get(F.map_values(sampled), F.lit(0))["difficult"]
    return F.coalesce(at("30d"), at("7d"), at("1d"), first, F.lit("unknown"))


def span_days(times: Column) -> Column:
    """Days between the first and the last time of a series, 0 for fewer than two."""
    return F.when(F.size(times) < 2, 0.0).otherwise(F.greatest((F.unix_micros(F.element_at(times, -1)) - F.unix_micros(F.get(times, F.lit(0)))) / F.lit(86_400_000_000.0), F.lit(0.0)))


def offsets_of(keys: Column) -> Column:
    """Days of horizon keys such as 30d, each once, the longest first."""
    return F.sort_array(F.array_distinct(F.filter(F.transform(keys, lambda k: F.regexp_extract(k, r"^(\d+)d$", 1).try_cast("int")), lambda d: d.isNotNull())), asc=False)


def schema_errors(answer: Column, series: Column, sampled: Column, offsets: list[int]) -> Column:
    """How many things are wrong with a market: an answer other than 0 and 1, probabilities outside 0 to 1, times that fall, no samples, samples that lack a part."""
    one = lambda c: F.coalesce(c, F.lit(True)).cast("int")
    bad_p = F.size(F.filter(series, lambda x: F.coalesce(~x["p_yes"].between(0, 1), F.lit(True))))
    fall = F.size(F.filter(F.transform(series, lambda x, i: F.when(i > 0, F.get(series, i - 1)["t"] > x["t"]).otherwise(False)), lambda f: F.coalesce(f, F.lit(False))))
    no_t = F.size(F.filter(series, lambda x: x["t"].isNull()))
    lack = F.size(F.filter(F.map_entries(sampled), lambda e: e["key"].isin([f"{d}d" for d in offsets]) & (e["value"]["p_yes"].isNull() | e["value"]["difficult"].isNull() | e["value"]["t"].isNull())))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return one(~answer.isin(0, 1)) + zero(F.when(series.isNotNull(), bad_p + fall + no_t)) + one(F.coalesce(F.size(sampled) == 0, F.lit(True))) + zero(F.when(sampled.isNotNull(), lack))


def by_coverage(duration: Column, volume: Column, key: Column) -> list[Column]:
    return [duration.desc(), volume.desc(), key]


def by_panel(sampled: Column, series: Column, key: Column) -> list[Column]:
    """More horizons first, then longer series, then the smaller key."""
    return [F.coalesce(F.size(sampled), F.lit(0)).desc(), F.coalesce(F.size(series), F.lit(0)).desc(), key]

"""Balanced samples: round robin in windows, greedy selection on counts of signatures."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_robin(df: DataFrame, groups: list[str], order: list[Column], n: int, most: int | None = None) -> DataFrame:
    """n rows: the first of each group in the order of groups, then the second, ...; at most `most` of a group. position is from 1.

    Each group passes on at most n rows, and the final sort takes n of each task.
    """
    nth = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    rows = df.withColumn("_nth", nth).filter(F.col("_nth") <= min(n, most or n))
    top = rows.orderBy("_nth", *groups).limit(n)
    return top.withColumn("position", F.row_number().over(Window.orderBy("_nth", *groups))).drop("_nth")  # n rows at most


def interleave(df: DataFrame, group: str, order: str) -> DataFrame:
    """Adds turn, group_size, first_seen; sorted by them, groups take turns, the largest first, and then the one seen first."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order))
    sizes = df.groupBy(group).agg(F.count("*").alias("group_size"), F.min(order).alias("first_seen"))
    return df.withColumn("turn", nth).join(sizes, group)


def sqrt_targets(counts: dict[str, int], total: int) -> dict[str, int]:
    """Shares by the roots of the counts, one at least; what is left goes to the largest remainders, what is too much comes off the largest shares, ties to the larger key."""
    whole = sum(n**0.5 for n in counts.values()) or 1.0
    exact = {k: total * n**0.5 / whole for k, n in counts.items()}
    out = {k: max(1, int(x)) for k, x in exact.items()}
    over = sum(out.values()) - total
    for k in sorted(exact, key=lambda k: (exact[k] - int(exact[k]), k), reverse=True)[: max(0, -over)]:
        out[k] += 1
    for k in [k for k in sorted(exact, key=lambda k: (exact[k], k), reverse=True) if out[k] > 1][: max(0, over)]:
        out[k] -= 1
    return dict(sorted(out.items()))


def uniform_targets(values: list[str], total: int) -> dict[str, int]:
    each, rest = divmod(total, max(1, len(values)))
    return {v: each + (i < rest) for i, v in enumerate(sorted(values, key=str))}


#: What a row's deficit counts in each column.
WEIGHTS = {"open_bucket": 3.0, "resolve_bucket": 3.0, "difficulty": 2.0, "domain": 1.5}
#: Columns in the order in which each value is taken once; the first one's targets go by roots, those of the others are even.
COVERED = ["domain", "difficulty", "open_bucket", "resolve_bucket"]
#: Signatures that may come to the driver.
MOST_SIGNATURES = 100_000


def select_subset(df: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """`size` rows, balanced over the columns in COVERED: first each value once, then by the weighted deficits, ties by a seeded draw. All rows, if there are no more.

    A row matters only by its signature (its values in those columns). Signatures and their counts come to the driver, not rows; more than MOST_SIGNATURES of them are an
    error. The choice says how many of each to take, and windows take those with the smallest hash of the key.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    counts = df.groupBy(*COVERED).count()
    if counts.limit(MOST_SIGNATURES + 1).count() > MOST_SIGNATURES:
        raise ValueError(f"more than {MOST_SIGNATURES} combinations of {COVERED}: put their values into fewer classes")
    take = choose({tuple(r[c] for c in COVERED): r["count"] for r in counts.collect()}, size, seed)
    rows = [(*k, n) for k, n in take.items()]
    if not rows:
        return df.limit(0)
    plan = df.sparkSession.createDataFrame(rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (df.schema[c] for c in COVERED)) + ", _take int")
    nth = F.row_number().over(Window.partitionBy(*COVERED).orderBy(F.xxhash64(key, F.lit(seed)), key))
    met = df.withColumn("_nth", nth).join(F.broadcast(plan), [df[c].eqNullSafe(plan[c]) for c in COVERED])
    return met.filter(F.col("_nth") <= F.col("_take")).select(*[df[c] for c in df.columns])


def targets(counts: dict[tuple, int], size: int) -> dict[str, dict]:
    """How many rows each value of each column should have."""
    out: dict[str, dict] = {}
    for i, c in enumerate(COVERED):
        each: Counter = Counter()
        for k, n in counts.items():
            each[k[i]] += n
        out[c] = sqrt_targets(each, size) if i == 0 else uniform_targets(list(each), size)
    return out


def choose(counts: dict[tuple, int], size: int, seed: int) -> dict[tuple, int]:
    """How many rows of each signature to take."""
    if sum(counts.values()) <= size:
        return dict(counts)
    goal = targets(counts, size)
    left, taken = dict(counts), Counter()
    have: dict[str, Counter] = {c: Counter() for c in COVERED}
    rng = random.Random(seed)
    draw = {k: rng.random() for k in sorted(counts, key=str)}

    def worth(k: tuple) -> tuple[float, float]:
        pull = sum(WEIGHTS[c] * max(0, goal[c][v] - have[c][v]) + 0.05 / (1 + have[c][v]) for c, v in zip(COVERED, k, strict=True))
        return pull, draw[k]

    def take(some: list[tuple]) -> None:
        if some and taken.total() < size:
            best = max(some, key=worth)
            taken[best] += 1
            left[best] -= 1
            if not left[best]:
                del left[best]
            for c, v in zip(COVERED, best, strict=True):
                have[c][v] += 1

    for i, c in enumerate(COVERED):
        for v in sorted(goal[c], key=lambda v: (goal[c][v], str(v)) if i == 0 else str(v)):  # noqa: B023
            take([k for k in left if k[i] == v])
    while left and taken.total() < size:
        take(list(left))
    return dict(taken)


def capped_panels(df: DataFrame, horizon: str, domain: str, order: list[Column], ratio: float, quota: int, least: int) -> DataFrame:
    """Panels by horizon: domains of fewer than `least` rows go, and of larger ones rows beyond max(quota, ratio * smallest domain)."""
    by = Window.partitionBy(horizon, domain)
    sizes = df.groupBy(horizon, domain).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    caps = sizes.groupBy(horizon).agg(F.greatest(F.lit(quota), F.floor(F.min("_n") * ratio)).alias("_cap"))
    rows = df.withColumn("_nth", F.row_number().over(by.orderBy(*order))).join(sizes, [horizon, domain], "left_semi").join(caps, horizon)
    return rows.filter(F.col("_nth") <= F.col("_cap")).drop("_nth", "_cap")


def water_fill(capacity: dict[str, int], total: int, least: int) -> dict[str, int]:
    """Targets within capacities: at least `least` each where there is room, the rest spread evenly over those with room."""
    out = {k: min(least, capacity[k]) for k in sorted(capacity)}
    room = total - sum(out.values())
    while room > 0 and (open_ := [k for k in out if out[k] < capacity[k]]):
        k = min(open_, key=lambda k: (out[k], k))
        out[k] += 1
        room -= 1
    return out

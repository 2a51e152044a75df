"""Time series of markets and streaks of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.storage import written


def daily_last(points: DataFrame, key: str, t: str, p: str, pos: str) -> DataFrame:
    """key, day, p: of the points with p from 0 to 1 the last listed (largest pos) of each UTC day."""
    return points.filter(F.col(p).between(0, 1)).groupBy(key, F.to_date(t).alias("day")).agg(F.max_by(p, pos).alias("p"))


def with_default(series: DataFrame, keys: DataFrame, key: str, day: Column, p: Column) -> DataFrame:
    """The series, and one point (day, p of keys) for each key that has none."""
    return series.unionByName(keys.join(series.select(key).distinct(), key, "left_anti").select(key, day.alias("day"), p.alias("p")))


def as_of(points: DataFrame, targets: DataFrame, key: str, t: str, p: str, target: str, forward_days: Column | None = None) -> DataFrame:
    """targets with value: the last p at or before the target time, else the first after it if within forward_days. Of points of one time the last has the largest p.

    Points and targets of a key stand in one order of time; each target looks back, and ahead, for the nearest point. No target meets more than that one.
    """
    tolerance = forward_days if forward_days is not None else F.lit(0)
    asked = targets.select(F.col(key).alias("_k"), F.col(target).alias("_t"), F.lit(1).alias("_asked"), F.lit(None).cast(points.schema[p].dataType).alias("_p"), tolerance.alias("_days"), F.struct(*targets.columns).alias("_row"))
    given = points.select(F.col(key).alias("_k"), F.col(t).alias("_t"), F.lit(0).alias("_asked"), F.col(p).alias("_p"))
    rows = given.unionByName(asked, allowMissingColumns=True)
    seen = F.when(F.col("_asked") == 0, F.struct("_t", "_p"))
    back = Window.partitionBy("_k").orderBy("_t", "_asked", "_p").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("_k").orderBy(F.col("_t").desc(), F.col("_asked").desc(), F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_back", F.last(seen, True).over(back)).withColumn("_ahead", F.last(seen, True).over(ahead)).filter("_asked = 1")
    late = F.unix_micros("_ahead._t") - F.unix_micros("_t")
    value = F.coalesce("_back._p", F.when(late <= F.col("_days") * F.lit(86_400_000_000), F.col("_ahead._p")))
    return rows.select("_row.*", value.alias("value"))


def forward_tolerance(offset_days: Column) -> Column:
    """A quarter of the offset, from one day to seven."""
    return F.least(F.greatest(F.floor(offset_days / 4), F.lit(1)), F.lit(7))


def volatility(series: DataFrame, key: str, t: str, p: str, points: int = 8) -> DataFrame:
    """Adds volatility: mean absolute change over the last `points` values up to each row; 0 where there is only one."""
    by = Window.partitionBy(key).orderBy(t)
    change = F.abs(F.col(p) - F.lag(p).over(by))
    recent = by.rowsBetween(-(points - 2), 0)
    return series.withColumn("_d", change).withColumn("volatility", F.coalesce(F.avg("_d").over(recent), F.lit(0.0))).drop("_d")


def latest(series: DataFrame, key: str, t: str, n: int) -> DataFrame:
    """The n last points of each key."""
    return series.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(t).desc()))).filter(F.col("_n") <= n).drop("_n")


def time_buckets(df: DataFrame, order: list[str], buckets: int, out: str = "bucket") -> DataFrame:
    """Adds a bucket from 0: position * buckets // count, by order. Positions come from a sort by ranges and counts by partition; no task sees all rows."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    rows = written(rows.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("bigint"), 33)), "order")
    counts = {r._part: r["count"] for r in rows.groupBy("_part").count().collect()}  # a row a partition
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    if not total:
        return df.withColumn(out, F.lit(0).cast("bigint"))
    offsets = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_part")).cast("bigint")
    return rows.withColumn(out, F.least(F.lit(buckets - 1).cast("bigint"), F.floor((offsets + F.col("_at")) * buckets / F.lit(total)))).drop("_part", "_at")


def streaks(df: DataFrame, key: str, order: str, failed: Column, threshold: int) -> DataFrame:
    """Adds streak (failures in a row up to this row, of its key) and skipped (an earlier row of the key had reached the threshold)."""
    by = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("_f", F.coalesce(failed, F.lit(False)).cast("int"))
    rows = rows.withColumn("_g", F.sum(1 - F.col("_f")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("streak", F.sum("_f").over(Window.partitionBy(key, "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    reached = F.max((F.col("streak") >= threshold).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("skipped", F.coalesce(reached == 1, F.lit(False))).drop("_f", "_g")


def short_circuit(df: DataFrame, key: str, order: str, failed: Column, least: int, ratio: float) -> DataFrame:
    """Adds seen, failures (both up to this row) and tripped: at least so many seen, of which at least that share failed."""
    by = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("seen", F.count("*").over(by)).withColumn("failures", F.sum(failed.cast("int")).over(by))
    return rows.withColumn("tripped", (F.col("seen") >= least) & (F.col("failures") / F.col("seen") >= ratio))


def within_budget(df: DataFrame, key: str, order: str, cost: Column, budget: float) -> DataFrame:
    """Adds spent (up to this row) and allowed (spent is within the budget)."""
    by = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(by)).withColumn("allowed", F.col("spent") <= budget)

"""Streams over growing folders, and state that survives between runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tail(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    """Rows of files as they come."""
    return spark.readStream.format(fmt).schema(schema).load(path)


def once(rows: DataFrame, key: str, time: str | None = None, late: str = "7 days") -> DataFrame:
    """Each key once. With a time column state is kept only for as long as rows may be late."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if time else rows.dropDuplicates([key])


def drain(rows: DataFrame, out: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Writes what has come since the last run, and ends. The checkpoint says where that was; a run that fails writes nothing twice."""
    rows.writeStream.format(fmt).option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def each_batch(rows: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def unseen(new: DataFrame, seen: DataFrame, key: str, pos: str) -> DataFrame:
    """New rows, the first of each key, whose keys weren't seen before; rows without a key all stay."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(pos))
    first = new.filter(F.col(key).isNotNull()).withColumn("_n", nth).filter("_n = 1").drop("_n")
    return first.join(seen.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new.filter(F.col(key).isNull()))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row a key: of all, the one of largest version; of equals the new one."""
    every = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = every.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*old.columns), F.struct(version, "_new")).alias("_row"))
    return best.select("_row.*")


def transition(pool: DataFrame, before: str, after: str, where: Column | None = None) -> DataFrame:
    """Rows of one status take another."""
    hit = (F.col("status") == before) & (where if where is not None else F.lit(True))
    return pool.withColumn("status", F.when(hit, F.lit(after)).otherwise(F.col("status")))


def reserve(pool: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The n oldest pending rows, and the pool in which they are in progress."""
    taken = pool.filter("status = 'pending'").orderBy("created_at", "url").limit(n)
    marked = pool.join(taken.select("url", F.lit(True).alias("_taken")), "url", "left")
    return taken, marked.withColumn("status", F.when(F.col("_taken"), "in_progress").otherwise(F.col("status"))).drop("_taken")


def high_water(rows: DataFrame, key: str, time: str, state: DataFrame, start: str) -> DataFrame:
    """Rows later than what their key had seen (state: key, last_seen), or than start."""
    met = rows.join(state.select(key, "last_seen"), key, "left")
    return met.filter(F.col(time) > F.greatest(F.coalesce("last_seen", F.lit(start).cast("timestamp")), F.lit(start).cast("timestamp"))).drop("last_seen")


def windows(rows: DataFrame, time: str, size: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """window_start, by, n: counts of tumbling windows; in a stream rows later than `late` are left out."""
    return rows.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")

"""What the corpus operators share: scratch folders, batch sizes, words, packed arrays, skew-safe joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.storage import shared_dir, written  # noqa: F401  the operators' own names for them

#: Words of a text: runs of digits, lower-case ASCII letters and non-ASCII characters, after lower-casing A-Z only.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower_ascii(text: str) -> str:
    """A-Z lower-cased and nothing else."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").translate(_LOWER_TABLE).decode("utf-8", "surrogatepass")


def lower_column(text: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() is the faster of the two and does just that to ASCII texts."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_column(text: Column) -> Column:
    """Words of a text column; null has none."""
    return F.array_remove(F.split(lower_column(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


#: By byte: 1 if it belongs to a word once A-Z are lower-cased (every byte of a non-ASCII character does).
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[65:91] += 32


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Long texts make the default of 10,000 rows in a batch too large for a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """Whole texts of a batch; null is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def with_arrays(batch: pa.RecordBatch, new: dict[str, pa.Array], keep: list[str]) -> pa.RecordBatch:
    """Kept columns, then the new ones."""
    return pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + list(new.values()), names=keep + list(new))


def kept(df: DataFrame, new: list[str]) -> list[str]:
    """Columns of the input that the result keeps: a column whose name (in any case) is that of a new one gives way to it."""
    taken = {x.lower() for x in new}
    return [c for c in df.columns if c.lower() not in taken]


def fs_of(path: str):
    """A pyarrow file system and the path within it; takes file:, hdfs:, s3: and plain paths."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


#: Rows of keys (some tens of bytes each) that may be broadcast. More of them meet their partners in a shuffle.
MOST_KEYS = 200_000


def free_name(columns: list[str], name: str) -> str:
    """The name, with as many underscores before it as it takes to be no column's in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def col(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(rows: DataFrame, gone: DataFrame, on: Column) -> DataFrame:
    """Rows without a partner in gone, a written table of keys: broadcast if it has MOST_KEYS rows at most, else shuffled."""
    return rows.join(F.broadcast(gone) if gone.limit(MOST_KEYS + 1).count() <= MOST_KEYS else gone, on, "left_anti")


def even_slot(spark: SparkSession, number: Column, parts: int) -> Column:
    """A column by which repartition(parts, column) deals rows of equal number (from 0) to one task and numbers 0 .. parts - 1 to a task each.

    A hash of the number itself would leave some tasks empty and give others several.
    """
    tried = spark.range(16 * parts + 64).select(F.col("id").cast("int").alias("x"))
    found = {r.part: r.x for r in tried.groupBy(F.pmod(F.hash("x"), F.lit(parts)).alias("part")).agg(F.min("x").alias("x")).collect()}
    values = [found.get(i, i) for i in range(parts)]  # as many numbers as tasks
    return F.element_at(F.lit(values).cast("array<int>"), (F.pmod(number, F.lit(parts)) + 1).cast("int")) if parts > 1 else F.lit(0)


def join_by_hot_key(rows: DataFrame, groups: DataFrame, key: str, count: str, most: int = 1000) -> DataFrame:
    """Left join of rows with one row per key (groups, whose column count tells how many rows have it), whatever the skew.

    groups is a written table. It is broadcast if it has MOST_KEYS rows at most. Else a key with over 1/most of all counted rows is hot: there
    are fewer than `most` hot keys, so that they are broadcast; the other keys meet in a shuffle join in which none has more than 1/most of the rows.
    """
    if groups.limit(MOST_KEYS + 1).count() <= MOST_KEYS:
        return rows.join(F.broadcast(groups), key, "left")
    total = groups.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > F.lit(max(1, total // most))
    extra = [c for c in groups.columns if c != key]
    near = rows.join(F.broadcast(groups.filter(hot).withColumn("_hot", F.lit(True))), key, "left")
    cold = near.filter("_hot is null").drop("_hot", *extra).join(groups.filter(~hot), key, "left")
    return near.filter("_hot").drop("_hot").unionByName(cold)

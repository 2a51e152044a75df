"""Exact top-k by inner product, without random access to the lists.

Candidates are dealt out into blocks of bounded size. A block has one list for each dimension, sorted by value; lists are made once and kept in a table. For a query, the
lists are read from their good ends in step: what a candidate has shown so far gives a lower bound of its score (what it has not shown counts as the
list's worst value) and an upper bound (what it has not shown counts as the value where the reading stands). The reading stops when no outsider, seen or not, can be
among the k best: all whose upper bound is below the k-th best score known. Those that still can are few then, and their final scores are resolved; where the lists
are read to their ends, the bounds are the scores. The k-th best score is carried from block to block. Blocks of queries meet blocks of candidates, and no row
meets a row in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import even_slot, small_batches, written

#: Rows of a block of candidates and of queries; blocks of candidates that one task reads in a row.
BLOCK, QUERIES, RUN = 8192, 1024, 4
#: Steps in which a list is read; the reading stops with so many candidates left for each of the k, or with this part of the block; queries that read together.
STEPS, FEW, FEW_PART, TOGETHER = 32, 2, 64, 64


def quantise(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, x as double; null for vectors that are null or hold null, NaN or infinite components."""
    ok = vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _dealt(df: DataFrame, rows: int, of: str, pack, ddl: str) -> tuple[DataFrame, int]:
    """The vectors of a dimension in blocks of at most so many rows on average, each packed into one row by pack(ids, matrix)."""
    n = max(1, -(-df.count() // rows))
    dealt = df.withColumn(of, F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n)).cast("int"))

    def run(keys, table):
        ids = table.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False).astype("<i8")
        values = table.column("v").combine_chunks()
        matrix = values.flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(len(ids), -1)
        return pa.table({"dim": pa.array([keys[0].as_py()], pa.int32()), of: pa.array([keys[1].as_py()], pa.int32()), **{k: pa.array([x], pa.int32() if k == "bytes" else pa.binary()) for k, x in pack(ids, matrix).items()}})

    return dealt.groupBy("dim", of).applyInArrow(run, f"dim int, {of} int, {ddl}"), n


def _narrow(x: np.ndarray) -> np.ndarray:
    """In the smallest signed type that holds it."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def pack_lists(ids: np.ndarray, matrix: np.ndarray) -> dict:
    """A block's lists: rows by rising value and the values, dimension by dimension. Rows are numbered by rising id, so that ties go by row."""
    order = np.argsort(ids, kind="stable")
    ids, matrix = ids[order], matrix[order]
    rows = np.argsort(matrix, axis=0, kind="stable").T
    values = _narrow(np.take_along_axis(matrix, rows.T, 0).T)
    return {"ids": ids.tobytes(), "rows": np.ascontiguousarray(rows, "<u4" if len(ids) > 1 << 16 else "<u2").tobytes(), "values": np.ascontiguousarray(values).tobytes(), "bytes": values.dtype.itemsize}


class Lists:
    """A block of candidates: for each dimension the values in rising order and the rows that have them. Counts what is read of them."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, values: np.ndarray):
        n = len(ids)
        self.ids, self.rows, self.values = ids, rows.astype(np.intp), np.ascontiguousarray(values)
        self.depths = np.unique(np.ceil(n * np.arange(1, STEPS + 1) / STEPS).astype(int))
        self.vectors = np.empty((n, len(values)), np.int64)  # for the candidates that are left
        np.put_along_axis(self.vectors, self.rows.T, self.values.T.astype(np.int64), 0)
        self.most = max(abs(int(values.min())), abs(int(values.max()))) if values.size else 0
        self.hint = 3 * STEPS // 4  # where the reading of a query begins to compare bounds
        self.read = self.resolved = self.asked = 0

    @classmethod
    def unpack(cls, dim: int, ids: bytes, rows: bytes, values: bytes, size: int) -> Lists:
        ids_ = np.frombuffer(ids, "<i8")
        shape = dim, len(ids_)
        return cls(ids_, np.frombuffer(rows, "<u4" if len(ids_) > 1 << 16 else "<u2").reshape(shape), np.frombuffer(values, f"<i{size}").reshape(shape))

    @classmethod
    def of(cls, ids: np.ndarray, matrix: np.ndarray) -> Lists:
        p = pack_lists(ids, matrix)
        return cls.unpack(matrix.shape[1], p["ids"], p["rows"], p["values"], p["bytes"])

    def _fronts(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each dimension the value where the reading stands, from above and from below."""
        return self.values[:, len(self.ids) - depth].astype(np.int64), self.values[:, depth - 1].astype(np.int64)

    def _upper(self, queries: np.ndarray, depth: int) -> np.ndarray:
        """Upper bounds of all rows (a column for each query) once lists are read to a depth: entry by entry in the lists' order, for some queries together."""
        n, whole = len(self.ids), depth == len(self.ids)
        top, bottom = self._fronts(depth)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        bound = 2 * self.most * int(np.abs(queries).max(initial=0)) * queries.shape[1]
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64  # sums are exact
        out = np.zeros((n, len(queries)), kind)
        sides = [(queries, slice(0, n), np.zeros_like(top))] if whole else [(up, slice(n - depth, n), top), (down, slice(0, depth), bottom)]
        for weights, part, front in sides:
            weights = np.ascontiguousarray(weights.T, kind)
            have, more = np.empty((depth, len(queries)), kind), np.empty((depth, len(queries)), kind)
            for j in np.flatnonzero(weights.any(1)):
                rows = self.rows[j, part]
                shown = (self.values[j, part].astype(np.int64) - front[j]).astype(kind)
                np.multiply(shown[:, None], weights[j], out=more)
                np.take(out, rows, axis=0, out=have, mode="clip")  # several times as fast as adding in place
                have += more
                out[rows] = have
        self.read += int((queries != 0).sum()) * depth
        return out if whole else out + (up @ top + down @ bottom).astype(kind)

    def best(self, queries: np.ndarray, k: int, bars: list[int | None], own: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query ids and scores of the k best rows, ties to the smaller id; scores below its bar may be left out. own are the rows that take no part."""
        out: list = [None] * len(queries)
        last = len(self.depths) - 1
        self.asked += len(queries)
        # Without a score to compare with, the bounds tell nobody apart before the lists' ends.
        turns = [(last, [i for i, b in enumerate(bars) if b is None]), (min(self.hint, last), [i for i, b in enumerate(bars) if b is not None])]
        few, late, easy = max(FEW * k, len(self.ids) // FEW_PART), 0, 0
        while turns:
            step, some = turns.pop()
            again = []
            upper = self._upper(queries[some], int(self.depths[step])) if some else None
            for c, i in enumerate(some):
                bound = upper[:, c].astype(np.int64)
                live = np.ones(len(bound), bool)
                live[own[i]] = False
                if step < last:
                    live &= bound >= bars[i]
                open_ = np.flatnonzero(live)
                if step < last and len(open_) > len(self.ids) // 8:
                    again.append(i)  # outsiders could still qualify, seen ones or not
                    continue
                easy += step < last and len(open_) <= few
                scores = bound[open_] if step == last else None
                out[i] = self._finished(queries[i], k, bars[i], open_, scores, step, few)
            if again:
                late += len(again)
                turns.append((min(last, step + 2), again))
        known = sum(b is not None for b in bars)
        self.hint = min(last, self.hint + 1) if 4 * late > known else max(0, self.hint - 1) if 2 * easy > known else self.hint
        return out

    def _finished(self, query: np.ndarray, k: int, bar: int | None, open_: np.ndarray, scores: np.ndarray | None, step: int, few: int) -> tuple[np.ndarray, np.ndarray]:
        """Reads on for the candidates that are open, until few are or the lists end; then resolves them."""
        dims = np.flatnonzero(query)
        q = query[dims]
        worst = np.where(q > 0, self.values[dims, 0], self.values[dims, -1]).astype(np.int64)
        while scores is None and len(open_) > few:
            step += 1
            top, bottom = self._fronts(int(self.depths[step]))
            self.read += len(dims) * int(self.depths[step] - self.depths[step - 1])
            front = np.where(q > 0, top[dims], bottom[dims])
            v = self.vectors[open_][:, dims]
            shown = np.where(q > 0, v >= front, v <= front)
            upper, lower = np.where(shown, v, front) @ q, np.where(shown, v, worst) @ q
            if len(open_) >= k:
                bar = max(bar, int(np.partition(lower, len(lower) - k)[len(lower) - k]))
            stay = upper >= bar
            open_ = open_[stay]
            if step == len(self.depths) - 1:
                scores = upper[stay]
        if scores is None:
            self.resolved += len(open_)
            scores = self.vectors[open_][:, dims] @ q
        if len(open_) > 4 * k:  # none below the k-th score is in the result
            high = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            open_, scores = open_[high], scores[high]
        top = np.lexsort((open_, -scores))[:k]
        return self.ids[open_[top]], scores[top]


def _merge(ids: np.ndarray, scores: np.ndarray, more: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    ids, scores = np.concatenate([ids, more[0]]), np.concatenate([scores, more[1]])
    top = np.lexsort((ids, -scores))[:k]
    return ids[top], scores[top]


_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of highest inner product for each query, ties to the smaller vec_id.

    Both have columns vec_id (long) and v (array of long, no nulls in it). A candidate with the query's own id takes no part; nor do rows
    whose vec_id or v is null, and candidates of another dimension than the query's. Fewer candidates than k give fewer ranks; empty tables
    give none. A repeated candidate row takes part as often as it stands there; a repeated query id is one query if its vectors are equal,
    and otherwise its smallest vector. Sums are 64-bit.
    """
    spark = queries.sparkSession
    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    some = lambda df: df.filter("vec_id is not null and v is not null").select("vec_id", F.size("v").alias("dim"), "v")
    ddl = "ids binary, rows binary, values binary, bytes int"
    pack_queries = lambda ids, matrix: {"ids": ids.tobytes(), "rows": b"", "values": matrix.tobytes(), "bytes": 8}
    asked, n_asked = _dealt(some(queries).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", F.size("v").alias("dim"), "v"), QUERIES, "q", pack_queries, ddl)
    given, n_given = _dealt(some(candidates), BLOCK, "c", pack_lists, ddl)
    # Blocks are few and large; each block of lists goes to every block of queries, which comes first in its task.
    runs = -(-n_given // RUN)
    asked = written(asked, "queries").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("c", F.lit(-1))
    given = written(given, "lists").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1)))).withColumn("run", F.floor(F.col("c") / RUN).cast("int"))
    names = ["dim", "q", "run", "c", "ids", "rows", "values", "bytes"]
    parts = max(1, min(n_asked * runs, 4096))
    slot = even_slot(spark, F.col("q") * runs + F.col("run"), parts)
    meet = asked.select(*names).unionByName(given.select(*names)).withColumn("slot", slot).repartition(parts, "slot").sortWithinPartitions("dim", "q", "run", "c")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, q_ids, vectors, best, hint = None, np.zeros(0, "<i8"), None, [], None

        def out() -> pa.RecordBatch:
            n = [len(x) for x, _ in best]
            flat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(flat([x for x, _ in best])), pa.array(flat([s for _, s in best]))], schema=_OUT)

        for b in batches:
            for r in b.to_pylist():
                if key != (r["dim"], r["q"], r["run"]):
                    if key is not None:
                        yield out()
                    key, q_ids, best = (r["dim"], r["q"], r["run"]), np.zeros(0, "<i8"), []
                if r["c"] < 0:
                    q_ids = np.frombuffer(r["ids"], "<i8")
                    vectors = np.frombuffer(r["values"], "<i8").reshape(len(q_ids), -1)
                    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_ids]
                elif len(q_ids):
                    lists = Lists.unpack(r["dim"], r["ids"], r["rows"], r["values"], r["bytes"])
                    lists.hint = lists.hint if hint is None else hint
                    for lo in range(0, len(q_ids), TOGETHER):
                        some = range(lo, min(lo + TOGETHER, len(q_ids)))
                        bars = [int(best[i][1][k - 1]) if len(best[i][1]) >= k else None for i in some]
                        own = [np.arange(*np.searchsorted(lists.ids, [q_ids[i], q_ids[i] + 1])) for i in some]
                        for i, found in zip(some, lists.best(vectors[lo : some.stop], k, bars, own), strict=True):
                            best[i] = _merge(*best[i], found, k)
                    hint = lists.hint
        if key is not None:
            yield out()

    from pyspark.sql import Window

    found = meet.select(*names).mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

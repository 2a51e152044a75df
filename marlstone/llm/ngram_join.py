"""Similarity join of texts by the Jaccard coefficient of their word n-grams, with Bayesian pruning.

Texts with the same set of n-grams are one class from the start (copies are never paired). Each class has MinHash values, which are cut into bands; the classes
that agree in a band are a bucket, and a pair of a link is in one of them but for a chance stated at BANDS. Buckets are dealt as blocks of bounded size, each pair of
blocks in one task. There the MinHash values of a pair are compared some at a time: the pair is dropped once the posterior probability that its coefficient reaches the
threshold, given the matches so far and a uniform prior, is below TOLERANCE. What is left joins classes into groups, which hold all pairs of a link, and a group's classes
get their n-grams. Within a group, again by blocks, pairs that pass the same comparison are verified exactly. What leaves a task are counts of links and a spanning
forest, never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import LOWER_BYTE, WORD_BYTE, col, free_name, join_by_hot_key, small_batches, without, written
from marlstone.llm.graph import components

#: Words of an n-gram, least coefficient of a link.
WORDS, THRESHOLD = 5, Fraction(4, 5)
#: Bands and values of a band: a pair at the threshold agrees in none with probability (1 - 0.8^5)^28 = 1.5e-5, at 0.85 with 2e-7.
BANDS, ROWS = 28, 5
#: MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 14, 1e-6
#: Classes in a block of a bucket; classes, and bytes of their n-grams, in a block of a group.
BUCKET_ROWS, BLOCK_ROWS, BLOCK_BYTES = 1024, 256, 24 << 20

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTES = _RNG.integers(0, 2**64, 256, _U, endpoint=False)
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _RNG.integers(0, 2**64, 64, _U, endpoint=False) | _U(1)
_A = _RNG.integers(0, 2**64, BANDS * ROWS, _U, endpoint=False) | _U(1)
_B = _RNG.integers(0, 2**64, BANDS * ROWS, _U, endpoint=False)
_POWERS: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) <= n:
        size = max(1 << 16, 2 * n)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, _U)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"], _POWERS["down"]


#: Bytes that are hashed at once.
SEGMENT = 4 << 20


def run_hashes(data: np.ndarray, inside_of: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each run of bytes that inside_of marks, and where it starts. Texts begin at the edges; no run goes beyond one.

    A hash is a polynomial of the bytes, made from differences of running sums for all runs of a segment at once; segments end between runs.
    """
    hashes, starts, lo = [np.zeros(0, _U)], [np.zeros(0, np.int64)], 0
    while lo < len(data):
        hi = lo + SEGMENT
        while hi < len(data) and inside_of[data[hi]]:
            gaps = np.flatnonzero(~inside_of[data[hi : hi + 4096]])
            hi += int(gaps[0]) if len(gaps) else 4096
        part = data[lo:hi]
        inside = np.concatenate([inside_of[part], [False]])
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = edges[np.searchsorted(edges, lo) : np.searchsorted(edges, lo + len(part))] - lo
        begins[cuts] = inside[cuts]
        first = np.flatnonzero(begins)
        ends = ~inside
        ends[1:][begins[1:] & inside[:-1]] = True  # a text's first word ends the last of the text before
        stops = np.flatnonzero(ends)
        stops = stops[np.searchsorted(stops, first, "right")]
        up, down = _powers(len(part) + 1)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTES[part] * up[: len(part)])])
        hashes.append(_mix((sums[stops] - sums[first]) * down[first] + (stops - first).astype(_U)))
        starts.append(first + lo)
        lo += len(part)
    return np.concatenate(hashes), np.concatenate(starts)


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array's texts, A-Z lower-cased, and where each text begins among them, then the end. Null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return LOWER_BYTE[np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]], offsets - offsets[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of a string array, in order, and where each text begins among them. Null is empty."""
    data, offsets = lowered(column)
    hashes, starts = run_hashes(data, WORD_BYTE, offsets[:-1][offsets[:-1] < offsets[1:]])
    return hashes, np.searchsorted(starts, offsets)


def gram_sets(column: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of n words; a shorter text has one run, one without words none."""
    hashes, first = word_hashes(column)
    m = len(hashes) - n + 1
    runs = np.zeros(max(m, 0), _U)
    for k in range(n):
        if m > 0:
            runs += _mix(hashes[k : k + m] * _PLACE[k])
    runs = _mix(runs)
    out = []
    for i in range(len(first) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            out.append(_mix(np.array([sum(int(_mix(hashes[a + k : a + k + 1] * _PLACE[8 + k])[0]) for k in range(b - a)) % 2**64], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def set_key(grams: np.ndarray) -> bytes | None:
    """128 bits of a set; null for the empty one."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of sets that aren't empty, a row for each. 16 bits of a value are kept: unequal ones agree by chance once in 65,536 cases, which prunes a little less."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    return np.stack([(np.minimum.reduceat(flat * a + b, starts) >> _U(48)).astype(np.uint16) for a, b in zip(_A, _B, strict=True)], 1)


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    x = values.reshape(len(values), BANDS, ROWS).astype(_U)
    key = np.arange(BANDS, dtype=_U)[None, :] * _PLACE[20] + _U(1)
    for r in range(ROWS):
        key = _mix(key * _PLACE[21 + r] + x[:, :, r])
    return key.view(np.int64)


def least_matches(threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE, values: int = BANDS * ROWS, step: int = STEP) -> list[tuple[int, int]]:
    """(values compared, matches with which a pair stays): with a uniform prior, the posterior of reaching t after m matches of n is P(Bin(n+1, t) <= m)."""
    t = float(threshold)
    out = []
    for n in range(step, values + 1, step):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= tolerance:
                out.append((n, m))
                break
    return out


_STAGES = least_matches()


def _left(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, stages: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of rows of MinHash values that aren't pruned."""
    same, done = np.zeros(len(i), np.int64), 0
    for n, least in stages:
        if not len(i):
            break
        same = same + (a[i, done:n] == b[j, done:n]).sum(1)
        stay = same >= least
        i, j, same, done = i[stay], j[stay], same[stay], n
    return i, j


def connected(a: dict[str, np.ndarray], b: dict[str, np.ndarray] | None, stages: list[tuple[int, int]] = _STAGES, threshold: Fraction = THRESHOLD) -> np.ndarray:
    """A label for each row of a block of a bucket, or of two: rows of a pair that isn't pruned have one. A block has v (MinHash values) and n (sizes of sets).

    Pairs that others have connected already aren't compared, so that a bucket of near copies takes about as many comparisons as it has rows.
    """
    v = a["v"] if b is None else np.concatenate([a["v"], b["v"]])
    n = a["n"] if b is None else np.concatenate([a["n"], b["n"]])
    num, den = threshold.numerator, threshold.denominator
    label = np.arange(len(n))
    for x in range(len(a["n"])):
        j = np.arange(x + 1 if b is None else len(a["n"]), len(n))
        j = j[(label[j] != label[x]) & (np.minimum(n[x], n[j]) * den >= num * np.maximum(n[x], n[j]))]
        _, j = _left(v, v, np.full(len(j), x), j, stages)
        if len(j):
            gone = np.zeros(len(n), bool)
            gone[label[j]] = True
            label[gone[label]] = label[x]
    return label


def candidates(a: dict[str, np.ndarray], b: dict[str, np.ndarray] | None, stages: list[tuple[int, int]] = _STAGES, threshold: Fraction = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of two blocks, or of one (i < j) if b is null, that aren't pruned; rising in i."""
    own, b = b is None, a if b is None else b
    num, den = threshold.numerator, threshold.denominator
    open_ = np.minimum.outer(a["n"], b["n"]) * den >= num * np.maximum.outer(a["n"], b["n"])
    if own:
        open_ &= np.arange(len(a["n"]))[:, None] < np.arange(len(a["n"]))
    return _left(a["v"], b["v"], *np.nonzero(open_), stages)


def verified(a: list[np.ndarray], b: list[np.ndarray] | None, i: np.ndarray, j: np.ndarray, threshold: Fraction = THRESHOLD) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j that it links to) among the pairs (i, j), which rise in i. Sets are sorted; null b stands for a."""
    num, den = threshold.numerator, threshold.denominator
    codes, code = np.unique(np.concatenate(a if b is None else [*a, *b]), return_inverse=True)
    cuts = np.cumsum([0, *map(len, a), *([] if b is None else map(len, b))])
    at = lambda x, off: code[cuts[x + off] : cuts[x + off + 1]]
    off = 0 if b is None else len(a)
    mark = np.zeros(len(codes), bool)
    for x in np.unique(i):
        lo, hi = np.searchsorted(i, [x, x + 1])
        js = j[lo:hi]
        sizes = cuts[js + off + 1] - cuts[js + off]
        mark[at(x, 0)] = True
        common = np.add.reduceat(mark[np.concatenate([at(y, off) for y in js])], np.cumsum([0, *sizes[:-1]]), dtype=np.int64)
        mark[at(x, 0)] = False
        linked = js[common * den >= num * (cuts[x + 1] - cuts[x] + sizes - common)]
        if len(linked):
            yield int(x), linked


def _signed(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, c (key of the text's n-gram set, null if empty), n (its size), v (MinHash values), bands."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = gram_sets(b.column(text))
            full = [i for i, s in enumerate(sets) if len(s)]
            v: list = [None] * len(sets)
            keys: list = [None] * len(sets)
            if full:
                values = minhash([sets[i] for i in full])
                for i, x, k in zip(full, values, band_keys(values).tolist(), strict=True):
                    v[i], keys[i] = x.tobytes(), k
            new = [pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(v, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + new, names=[*keep, "c", "n", "v", "bands"])

    new = [T.StructField("c", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("v", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return df.mapInArrow(run, T.StructType([*(df.schema[k] for k in keep), *new]))


def _grams(df: DataFrame) -> DataFrame:
    """c, text -> c and the n-grams (packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = gram_sets(b.column(1))
            if [set_key(s) for s in sets] != b.column(0).to_pylist():
                raise ValueError("the texts gave other rows when they were read again: write them to a table first")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["c", "grams"])

    return df.select("c", "_text").mapInArrow(run, "c binary, grams binary")


_KEY = ["group", "i", "j"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], list[dict] | None]]:
    """Rows sorted by _KEY -> for each pair of blocks the rows of block i, and those of block j (null if it is the same block)."""
    key, rows = None, []

    def out():
        left = [r for r in rows if r["own"] == key[1]]
        right = None if key[1] == key[2] else [r for r in rows if r["own"] != key[1]]
        if len(left) > 1 if right is None else left and right:
            yield left, right

    for b in batches:
        for r in b.to_pylist():
            now = (r["group"], r["i"], r["j"])
            if now != key:
                if rows:
                    yield from out()
                key, rows = now, []
            rows.append(r)
    if rows:
        yield from out()


def _block(rows: list[dict] | None) -> dict[str, np.ndarray] | None:
    if rows is None:
        return None
    return {"v": np.frombuffer(b"".join(r["v"] for r in rows), np.uint16).reshape(len(rows), -1), "n": np.array([r["n"] for r in rows])}


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pairs of blocks of buckets -> a, b: edges of a forest that connects what isn't pruned."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    edges: tuple[list, list] = ([], [])
    for left, right in _groups(batches):
        every = left + (right or [])
        label = connected(_block(left), _block(right))
        for x in np.flatnonzero(label != np.arange(len(every))).tolist():
            edges[0].append(every[x]["c"])
            edges[1].append(every[int(label[x])]["c"])
        if len(edges[0]) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in edges], schema=schema)
            edges = ([], [])
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in edges], schema=schema)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pairs of blocks with n-grams -> c, links (how many this pair of blocks adds), root (of c in this pair's links)."""
    schema = pa.schema([("c", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])
    cs: list[bytes] = []
    links: list[int] = []
    roots: list[bytes] = []
    for left, right in _groups(batches):
        i, j = candidates(_block(left), _block(right))
        every = left + (right or [])
        count, root = np.zeros(len(every), np.int64), list(range(len(every)))

        def find(x: int, root: list[int] = root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        sets = lambda rs: [np.frombuffer(r["grams"], _U) for r in rs]
        for x, ys in verified(sets(left), None if right is None else sets(right), i, j) if len(i) else ():
            at = ys if right is None else ys + len(left)
            count[x] += len(at)
            count[at] += 1
            top = find(x)
            for y in at.tolist():
                root[find(y)] = top
        for x in np.flatnonzero(count).tolist():
            cs.append(every[x]["c"])
            links.append(int(count[x]))
            roots.append(every[find(x)]["c"])
        if len(cs) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(cs, pa.binary()), pa.array(links, pa.int64()), pa.array(roots, pa.binary())], schema=schema)
            cs, links, roots = [], [], []
    if cs:
        yield pa.RecordBatch.from_arrays([pa.array(cs, pa.binary()), pa.array(links, pa.int64()), pa.array(roots, pa.binary())], schema=schema)


def numbered(docs: DataFrame, uid: str = "_uid") -> DataFrame:
    """docs with the number of each row in a column uid, from a table: later scans may be split otherwise, but find the same numbers."""
    return written(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", uid: str | None = None) -> DataFrame:
    """For each row of docs: the key, class_id, n_links, n_copies, first, _uid (its number in numbered(docs), or what the column uid of docs has).

    n_copies is the number of rows with the same set of n-grams, itself included; n_links the number of other such sets that link to its own (coefficient at least
    THRESHOLD). class_id is the smallest key in the component of links; first tells one row of each component (that of the smallest key; null keys come last).
    Texts of fewer words than an n-gram have one, of all their words; texts without words (null, empty) are alone: their class is their key. An empty
    table gives none. Repeated rows are copies. Other columns of docs, whatever their names, take no part. docs is read once, and numbered and written then; with
    uid, it must be a table that numbered() wrote. A lost executor costs recomputation only: intermediate tables are in the shared folder.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if uid is None:
        docs, uid = numbered(docs.select(col(key).alias("_key"), col(text).alias("_text"))), "_uid"
        rows = docs
    else:
        rows = docs.select(col(uid).alias("_uid"), col(key).alias("_key"), col(text).alias("_text"))
    signed = written(_signed(rows, "_text", ["_uid", "_key"]), "signed")
    # Nulls last: a struct compares by its fields in turn.
    order = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_uid").alias("uid"))
    classes = written(signed.filter("c is not null").groupBy("c").agg(F.min(order).alias("rep"), F.count("*").alias("n_copies"), F.first("n").alias("n"), F.first("v").alias("v"), F.first("bands").alias("bands")), "classes")
    bands = classes.select("c", F.explode("bands").alias("band"))
    of = lambda seed: F.bit_xor(F.xxhash64("c", F.lit(seed)))
    shared = bands.groupBy("band").agg(F.count("*").alias("size"), F.min("c").alias("least"), of(1).alias("x"), of(2).alias("y")).filter("size > 1")
    # Buckets of the same classes give the same: one of them is enough.
    shared = shared.groupBy("size", "least", "x", "y").agg(F.min("band").alias("band"))
    shared = written(shared.select("band", "size", F.ceil(F.col("size") / BUCKET_ROWS).cast("int").alias("blocks")), "buckets")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def by_blocks(df: DataFrame, *columns: str) -> DataFrame:
        """Rows of groups (with their number of blocks), each with every pair of blocks that its own is in."""
        df = df.withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        df = df.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "c", *columns)
        return df.repartition(parts, *_KEY).sortWithinPartitions(*_KEY)

    inside = join_by_hot_key(bands, shared, "band", "size").filter("blocks is not null").select(F.col("band").alias("group"), "blocks", "c")
    near = by_blocks(inside.join(classes.select("c", "v", "n"), "c"), "v", "n").mapInArrow(_connect, "a binary, b binary")
    near = written(components(written(near, "near")), "near_groups")
    sizes = near.join(classes.select(F.col("c").alias("node"), "n"), "node").groupBy("label").agg(F.count("*").alias("size"), F.sum(F.col("n") * 8).alias("bytes"))
    sizes = written(sizes.select("label", "size", F.ceil(F.greatest(F.col("size") / BLOCK_ROWS, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")), "sizes")
    members = join_by_hot_key(near, sizes, "label", "size").select(F.col("node").alias("c"), F.col("label").alias("group"), "blocks")
    members = written(members.join(classes.select("c", "n", "v", F.col("rep.uid").alias("_uid"), F.lit(1).alias("one")), "c"), "members")
    # One text of each class, by the row's number in the table.
    asked = written(members.select("_uid", "c", "one"), "asked")
    grams = written(_grams(join_by_hot_key(rows.select("_uid", "_text"), asked, "_uid", "one").filter("c is not null")), "grams")
    links = by_blocks(members.join(grams, "c"), "v", "n", "grams").mapInArrow(_compare, "c binary, links bigint, root binary")
    links = written(links, "links")
    counts = links.groupBy("c").agg(F.sum("links").alias("n_links"))
    groups = components(links.filter("c <> root").select(F.col("c").alias("a"), F.col("root").alias("b")))
    known = classes.select("c", "rep", "n_copies").join(counts, "c", "left").join(groups.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    known = written(known, "known")
    tops = written(known.groupBy("label").agg(F.min("rep").alias("top"), F.count("*").alias("group_size")), "tops")
    each = written(join_by_hot_key(known, tops, "label", "group_size").select("c", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "top"), "verdicts")
    out = join_by_hot_key(signed.select("_uid", "_key", "c"), each, "c", "n_copies")
    return out.select(
        "_uid", F.col("_key").alias(key), F.when(F.col("c").isNull(), F.col("_key")).otherwise(F.col("top.key")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.coalesce("n_copies", F.lit(1).cast("bigint")).alias("n_copies"), (F.col("c").isNull() | (F.col("top.uid") == F.col("_uid"))).alias("first"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are first in their component, as they are, whatever the names of their columns.

    Null and empty texts stay, an empty table gives none, of repeated rows one stays. Rows are numbered once, in a table that the last scan reads too.
    """
    uid = free_name(docs.columns, "_uid")
    rows = numbered(docs, uid)
    drop = free_name([*docs.columns, uid], "_drop")
    gone = written(join(rows, key, text, uid).filter(~F.col("first")).select(F.col("_uid").alias(drop)), "dropped")
    return without(rows, gone, F.col(uid) == F.col(drop)).select(*map(col, docs.columns))

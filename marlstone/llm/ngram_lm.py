"""Language-model scores from an Elias-Fano n-gram trie in memory-mapped levels.

First level: the words, by 64-bit hash; a word's id is its rank. Second level: the successors of each word, third: those of each pair. A level's contexts are the
nodes of the one before (and the begin of a text, which is a context only); the ids of a context's successors rise, and are shifted past the last value of the context
before, so that a level is one monotone sequence in Elias-Fano form (low parts in whole bytes, high parts as a bit vector with counts by 64 bits); pointers to
each context's range are another. A successor is searched relative to its context: the shift is the value before its range. The model interpolates
discounted counts: P(w|uv) = A(uvw) + R(uv) P(w|v), P(w|v) = A(vw) + R(v) P(w), A = (count - DISCOUNT) / total, R = DISCOUNT kinds / total,
and P(w) comes from the number of contexts that w was seen in. A, R and P(w) are kept as codes of eight bits with a table of their values by shard. Each level is cut
into shards, ranges of its contexts; a shard is one file in the shared folder, which workers map when first asked.
"""

from __future__ import annotations

import json
import mmap
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import col, even_slot, fs_of, kept, shared_dir, small_batches
from marlstone.llm.ngram_join import lowered, run_hashes

#: What is taken off each count of a pair or of three words, for what wasn't seen.
DISCOUNT = 0.75
#: Added to each count of a word.
ADDED = 0.1
#: Keys that a task gathers before it sums them up; most shards; bytes of text that are put together, and tokens that are looked up at once.
GATHER, MOST_SHARDS, TEXT_BYTES, MOST_TOKENS = 2_000_000, 4096, 2 << 20, 1 << 19
#: Tasks whose counts meet in one place; those of more are summed in rounds.
FAN_IN = 256
#: Ids of words have 32 bits in keys.
MOST_WORDS = (1 << 32) - 2

_U = np.uint64
_END = _U(0x5EED0FE17D)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_WORKER: dict = {}
_MAPPED: list[mmap.mmap] = []


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each text, an end after each, and where each text begins among them. Null is empty."""
    data, offsets = lowered(column)
    hashes, starts = run_hashes(data, ~_BLANK, offsets[:-1][offsets[:-1] < offsets[1:]])
    first = np.searchsorted(starts, offsets)
    return np.insert(hashes, first[1:], _END), first + np.arange(len(first))


def pieces(hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Tokens, and which of them begin a text, some at a time, so that a long text takes no more memory than others. Each piece has the two tokens before it too: how many go."""
    begins = np.zeros(len(hashes), bool)
    begins[first[:-1]] = True
    for at in range(0, len(hashes), MOST_TOKENS):
        lo = max(0, at - 2)
        yield hashes[lo : at + MOST_TOKENS], begins[lo : at + MOST_TOKENS], at - lo


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards of words are ranges of hashes, so that ids follow the order of shards."""
    return (((hashes >> _U(32)) * _U(shards)) >> _U(32)).astype(np.int64)


def shard_start(shard: int, shards: int) -> int:
    """The least hash of a shard."""
    return -(-(shard << 32) // shards) << 32


#: Ones in a byte, and where the k-th one of a byte stands.
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)
_KTH = np.array([[next((i for i in range(8) if x >> i & 1 and bin(x & ((1 << i) - 1)).count("1") == k), 0) for k in range(8)] for x in range(256)], np.uint8)


class EliasFano:
    """A rising sequence of numbers. Low parts take whole bytes, in arrays of 4, 2 and 1; high parts are a bit vector, one after `gap` zeros."""

    def __init__(self, n: int, width: int, low: list[np.ndarray], bits: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.bits, self.zeros, self.ones = n, width, low, bits.reshape(-1, 8), zeros, ones

    @staticmethod
    def parts(values: np.ndarray) -> dict[str, np.ndarray]:
        n = len(values)
        bound = int(values[-1]) + 1 if n else 1
        width = 8 * min(7, max(1, -(-((bound // max(1, n)).bit_length() - 2) // 8)))
        out, shift = {}, 0
        for i, size in enumerate(_sizes(width)):
            out[f"low{i}"] = ((values >> _U(shift)) & _U((1 << 8 * size) - 1)).astype(f"u{size}")
            shift += 8 * size
        high = (values >> _U(width)).astype(np.int64) if n else np.zeros(0, np.int64)
        size = n + (bound >> width) + 1
        flags = np.zeros(-(-size // 64) * 64, np.uint8)
        flags[high + np.arange(n)] = 1
        ones = np.concatenate([[0], np.cumsum(flags.reshape(-1, 64).sum(1, dtype=np.int64))])
        zeros = np.arange(len(ones)) * 64 - ones
        if int(zeros[-1]) >= 1 << 32 or n >= 1 << 32:
            raise ValueError("a shard has too many entries: more shards are needed")
        return out | {"meta": np.array([n, width]), "bits": np.packbits(flags, bitorder="little"), "ones": ones.astype(np.uint32), "zeros": zeros.astype(np.uint32)}

    @classmethod
    def of(cls, parts: dict[str, np.ndarray]) -> EliasFano:
        n, width = (int(x) for x in parts["meta"])
        return cls(n, width, [parts[f"low{i}"] for i in range(len(_sizes(width)))], parts["bits"], parts["zeros"], parts["ones"])

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Where the k-th (from 0) bit of the kind stands."""
        counts = self.ones if bit else self.zeros
        word = np.searchsorted(counts, k.astype(counts.dtype), "right") - 1
        eight = self.bits[word]
        if not bit:
            eight = ~eight
        rank = k - counts[word].astype(np.int64)
        upto = np.cumsum(_ONES[eight], axis=1, dtype=np.uint8)
        byte = (upto <= rank[:, None].astype(np.uint8)).sum(1)
        at = np.arange(len(k))
        rank -= np.where(byte > 0, upto[at, byte - 1], 0)
        return word * 64 + byte * 8 + _KTH[eight[at, byte], rank]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        out = self.low[0][i].astype(_U)
        shift = 8 * self.low[0].itemsize
        for x in self.low[1:]:
            out |= x[i].astype(_U) << _U(shift)
            shift += 8 * x.itemsize
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        high = self._select(i, 1) - i
        return (high.astype(_U) << _U(self.width)) | self._lows(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Where each value stands, -1 if it doesn't: its high part's range is between two zeros, and the low parts there are compared."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        high = (values >> _U(self.width)).astype(np.int64)
        where = np.flatnonzero(high < int(self.zeros[-1]))  # zeros there are, padding included
        h = high[where]
        new, back = _runs(h)  # values come sorted, so that equal high parts stand together
        each = h[new]
        ends = np.minimum(self._select(each, 0) - each, self.n)
        begins = np.zeros(len(each), np.int64)
        later = each > 0
        begins[later] = self._select(each[later] - 1, 0) - (each[later] - 1)
        at, to = begins[back], ends[back]
        low = values[where] & _U((1 << self.width) - 1)
        live = np.flatnonzero(at < to)
        while len(live):
            # Halving: low parts rise within a high part.
            mid = (at[live] + to[live]) >> 1
            got = self._lows(mid)
            want = low[live]
            hit = got == want
            out[where[live[hit]]] = mid[hit]
            less = got < want
            at[live[less]] = mid[less] + 1
            to[live[~less]] = mid[~less]
            live = live[~hit & (at[live] < to[live])]
        return out


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows differ from the one before, and the number of such rows up to each, from 0."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new, np.cumsum(new) - 1


def _sizes(width: int) -> list[int]:
    """Bytes of the arrays that low parts of a width are kept in."""
    return [size for size in (4, 2, 1) if width // 8 & size]


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of eight bits and the table of their values: up to 256 distinct values are kept, of more each of 256 equal steps has the mean of its values."""
    known = np.unique(values)
    if len(known) <= 256:
        return np.searchsorted(known, values).astype(np.uint8), np.pad(known, (0, 256 - len(known))).astype(np.float32)
    low, high = float(known[0]), float(known[-1])
    codes = np.minimum((values - low) * (256 / (high - low)), 255).astype(np.uint8)
    n = np.bincount(codes, minlength=256)
    return codes, (np.bincount(codes, values, 256) / np.maximum(n, 1)).astype(np.float32)


def _chances(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by logarithm, and the values themselves."""
    codes, table = quantised(np.log10(x))
    return codes, (10.0 ** table.astype(np.float64)).astype(np.float32)


def _save(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """One file of a shard, under a name of its own; a task that runs twice leaves a file that nobody names."""
    name = uuid.uuid4().hex
    fs, base = fs_of(folder)
    fs.create_dir(base, recursive=True)
    arrays = {k: np.ascontiguousarray(v) for k, v in arrays.items()}
    at, where = 0, {}
    for k, v in arrays.items():
        where[k] = (at, v.dtype.str, len(v))
        at += -(-v.nbytes // 64) * 64
    head = json.dumps(where).encode()
    head = head + b" " * (-(len(head) + 8) % 64)
    with fs.open_output_stream(f"{base}/{name}.trie", compression=None) as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for v in arrays.values():
            f.write(v.tobytes() + bytes(-v.nbytes % 64))
    return name


def _open(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a shard's file, mapped. Off a mounted folder the file is copied to one without a name first, so that memory holds no level. Each worker opens a file once."""
    key = (folder, name)
    if key not in _WORKER:
        fs, base = fs_of(folder)
        path = f"{base}/{name}.trie"
        if fs.type_name == "local":
            with open(path, "rb") as f:
                mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            with tempfile.TemporaryFile() as copy, fs.open_input_stream(path, compression=None) as f:
                while part := f.read(8 << 20):
                    copy.write(part)
                copy.flush()
                mapped = mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_READ)
        _MAPPED.append(mapped)
        size = int.from_bytes(mapped[:8], "little")
        where = json.loads(mapped[8 : 8 + size])
        _WORKER[key] = {k: np.frombuffer(mapped, np.dtype(t), n, 8 + size + at) for k, (at, t, n) in where.items()}
    return _WORKER[key]


def _release() -> None:
    """Gives back the pages of mapped files that were touched; the system keeps them as long as it has room, and maps them again when they are asked for."""
    for mapped in _MAPPED:
        mapped.madvise(mmap.MADV_DONTNEED)


def _sequence(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano.of({k.removeprefix(f"{name}_"): v for k, v in arrays.items() if k.startswith(f"{name}_")})


def _named(parts: dict[str, np.ndarray], name: str) -> dict[str, np.ndarray]:
    return {f"{name}_{k}": v for k, v in parts.items()}


class Words:
    """The first level: ids, counts and probabilities of words."""

    def __init__(self, folder: str, names: dict[int, str], sizes: dict[int, int], tokens: int, shards: int):
        self.folder, self.names, self.tokens, self.shards = folder, names, tokens, shards
        self.base = np.cumsum([0] + [sizes.get(s, 0) for s in range(shards)])
        self.chances: dict[int, str] = {}
        self.kinds = 0  # pairs there are
        if self.distinct > MOST_WORDS:
            raise ValueError(f"{self.distinct} distinct tokens do not fit the keys of pairs")

    @property
    def distinct(self) -> int:
        return int(self.base[-1])

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (-1: unknown), counts and probabilities of sorted distinct hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        chance = np.full(len(hashes), self.chance(0))
        shard = shard_of(hashes, self.shards)
        for s in np.unique(shard).tolist():
            if s in self.names:
                a, b = np.searchsorted(shard, [s, s + 1])
                arrays = _open(self.folder, self.names[s])
                at = _sequence(arrays, "hashes").find(hashes[a:b] - _U(shard_start(s, self.shards)))
                ok = np.flatnonzero(at >= 0)
                ids[a + ok] = at[ok] + self.base[s]
                counts[a + ok] = arrays["counts"][at[ok]]
                if s in self.chances:
                    arrays = _open(self.folder, self.chances[s])
                    chance[a + ok] = arrays["table"][arrays["codes"][at[ok]]]
        return ids, counts, chance

    def chance(self, kinds):
        """P(w) of a word that has been seen after so many kinds of words."""
        return (kinds + ADDED) / (self.kinds + ADDED * (self.distinct + 1))

    def log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADDED) / (self.tokens + ADDED * (self.distinct + 1)))


class Level:
    """A further level: successors of contexts. Shards are ranges of contexts; begins are the first context of each and the end."""

    def __init__(self, folder: str, begins: np.ndarray, names: dict[int, str], sizes: dict[int, int]):
        self.folder, self.begins, self.names = folder, begins, names
        self.base = np.cumsum([0] + [sizes.get(s, 0) for s in range(len(begins) - 1)])

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted distinct pairs of a context and a word's id: node (-1: none), A (0: none), and R of the context (1 where it has no successor)."""
        n = len(context)
        node, a, r = np.full(n, -1, np.int64), np.zeros(n), np.ones(n)
        shard = np.searchsorted(self.begins, context, "right") - 1
        for s in np.unique(shard).tolist():
            if s not in self.names:
                continue
            lo, hi = np.searchsorted(shard, [s, s + 1])
            arrays = _open(self.folder, self.names[s])
            pointers, successors = _sequence(arrays, "pointers"), _sequence(arrays, "successors")
            new, back = _runs(context[lo:hi])
            each = context[lo:hi][new]
            local = each - self.begins[s]
            begin, end = pointers.access(local).astype(np.int64), pointers.access(local + 1).astype(np.int64)
            later = (begin < end) & (begin > 0)
            shift = np.zeros(len(each), _U)
            shift[later] = successors.access(begin[later] - 1) + _U(1)
            some = begin < end
            rest = np.ones(len(each))
            rest[some] = arrays["rest_table"][arrays["rest"][local[some]]]
            r[lo:hi] = rest[back]
            # A value beyond the context's range is another context's: it is no successor of this one.
            asked = np.flatnonzero(some[back])
            own = back[asked]
            found = successors.find(shift[own] + word[lo:hi][asked].astype(_U))
            ok = (found >= begin[own]) & (found < end[own])
            at = lo + asked[ok]
            node[at] = found[ok] + self.base[s]
            a[at] = arrays["table"][arrays["codes"][found[ok]]]
        return node, a, r


_PACKED = pa.schema([("shard", pa.int32()), ("task", pa.int32()), ("keys", pa.binary()), ("far", pa.binary()), ("counts", pa.binary()), ("many", pa.binary())])
_PACKED_DDL = "shard int, task int, keys binary, far binary, counts binary, many binary"


def pack(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Sorted keys as differences of 32 bits and the high parts of those that need more; counts as bytes and those of 255 or more."""
    steps = np.diff(keys, prepend=_U(0))
    far = np.flatnonzero(steps >> _U(32))
    many = counts >= 255
    return steps.astype(np.uint32).tobytes(), np.stack([far.astype(_U), steps[far] >> _U(32)]).tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[many].astype(np.int64).tobytes()


def unpack(keys: bytes, far: bytes, counts: bytes, many: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps = np.frombuffer(keys, np.uint32).astype(_U)
    where, high = np.frombuffer(far, _U).reshape(2, -1)
    steps[where.astype(np.int64)] |= high << _U(32)
    n = np.frombuffer(counts, np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(many, np.int64)
    return np.cumsum(steps, dtype=_U), n


def _packed(shards: np.ndarray, keys: np.ndarray, counts: np.ndarray, task: int) -> pa.RecordBatch:
    """Keys that rise within each shard, and their counts, a row for each shard; shards rise."""
    some, first = np.unique(shards, return_index=True)
    cuts = [*first.tolist(), len(keys)]
    rows = [pack(keys[a:b], counts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([task] * len(rows), pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], schema=_PACKED)


def _summed(shards: np.ndarray, keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shard, key) in order, and their counts added up (ones, if null)."""
    order = np.argsort(keys)
    order = order[np.argsort(shards.astype(np.uint16)[order], kind="stable")]
    s, k = shards[order], keys[order]
    if not len(k):
        return s, k, np.zeros(0, np.int64)
    first = np.flatnonzero(_runs(s, k)[0])
    n = np.diff(np.append(first, len(k))) if counts is None else np.add.reduceat(counts[order].astype(np.int64), first)
    return s[first], k[first], n


class _Gathered:
    """Shards, keys and counts that come in pieces; they are summed up whenever there are GATHER more."""

    def __init__(self):
        self.pieces: list = []
        self.fresh = 0

    def add(self, shards: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> None:
        self.pieces.append((shards.astype(np.uint16), keys, counts))
        self.fresh += len(keys)
        if self.fresh >= GATHER:
            self.pieces, self.fresh = [self.total()], 0

    def total(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.pieces:
            return np.zeros(0, np.uint16), np.zeros(0, _U), np.zeros(0, np.int64)
        return self.pieces[0] if len(self.pieces) == 1 else _summed(*(np.concatenate(x) for x in zip(*self.pieces, strict=True)))


def _columns(batches: Iterator[pa.RecordBatch], column: str | int = 0) -> Iterator[tuple[pa.Table, pa.Array]]:
    """Batches put together up to TEXT_BYTES of text (or as they are, if larger), and their texts."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out() -> tuple[pa.Table, pa.Array]:
        table = pa.Table.from_batches(held)
        return table, pa.concat_arrays([b.column(column).cast(pa.large_string()) for b in held])

    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= TEXT_BYTES:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _count(df: DataFrame, keys_of: Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Shards and keys of all texts, from their tokens (as pieces() gives them), counted in each task: packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        have = _Gathered()
        for _, texts in _columns(batches):
            for piece in pieces(*token_hashes(texts)):
                have.add(*_summed(*keys_of(*piece)))
                _release()
            if len(have.pieces) == 1 and len(have.pieces[0][1]) >= 2 * GATHER:
                yield _packed(*have.total(), task)
                have = _Gathered()
        yield _packed(*have.total(), task)

    return df.mapInArrow(run, _PACKED_DDL)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows sorted by shard -> shard, keys, counts, added up as they come."""
    now, have = None, _Gathered()
    for b in batches:
        for s, *packed in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
            if s != now:
                if now is not None:
                    yield now, *have.total()[1:]
                now, have = s, _Gathered()
            keys, counts = unpack(*packed)
            have.add(np.zeros(len(keys), np.uint16), keys, counts)
    if now is not None:
        yield now, *have.total()[1:]


_BUILT = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("size", pa.int64()), ("total", pa.int64())])
_BUILT_DDL = "shard int, name string, size bigint, total bigint"


def _store(rows: DataFrame, tasks: int, shards: int, save: Callable[[int, np.ndarray, np.ndarray], tuple[str, int, int]]) -> DataFrame:
    """A row for each shard of packed rows, whose keys and counts are given to save(): its name, size and total. Counts of many tasks are summed in rounds, so that no place has more than FAN_IN of them."""

    def merge(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_packed(np.full(len(k), s), k, n, t.column("task")[0].as_py()) for s, k, n in _by_shard(iter(t.combine_chunks().to_batches()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, k, n in _by_shard(batches):
            name, size, total = save(s, k, n)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([name]), pa.array([size], pa.int64()), pa.array([total], pa.int64())], schema=_BUILT)

    spark = rows.sparkSession
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        rows = rows.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("task", "shard").applyInArrow(merge, _PACKED_DDL)
    return rows.repartition(shards, even_slot(spark, F.col("shard"), shards)).sortWithinPartitions("shard").mapInArrow(build, _BUILT_DDL)


def _level_arrays(local: np.ndarray, word: np.ndarray, n: np.ndarray, contexts: int) -> dict[str, np.ndarray]:
    """The arrays of a shard: for sorted (context, word) and their counts, contexts numbered from 0."""
    kinds = np.bincount(local, minlength=contexts)
    pointers = np.concatenate([[0], np.cumsum(kinds)])
    # Each range is shifted past the value before it.
    last = word[np.maximum(pointers[1:] - 1, 0)].astype(np.int64) + 1 if len(word) else np.zeros(contexts, np.int64)
    last[kinds == 0] = 0
    shift = np.concatenate([[0], np.cumsum(last)[:-1]]) if contexts else np.zeros(0, np.int64)
    total = np.maximum(np.bincount(local, n, contexts), 1)
    codes, table = _chances((n - DISCOUNT) / total[local])
    rest, rest_table = _chances(np.where(kinds > 0, DISCOUNT * kinds / total, 1.0))
    return _named(EliasFano.parts((word + shift[local]).astype(_U)), "successors") | _named(EliasFano.parts(pointers.astype(_U)), "pointers") | {"codes": codes, "table": table, "rest": rest, "rest_table": rest_table}


class Trie:
    """A trained model: where its files are, by shard. It is small; the levels stay in their files."""

    def __init__(self, words: Words):
        self.words = words
        self.pairs: Level | None = None
        self.threes: Level | None = None

    @property
    def begin(self) -> int:
        """The context that a text begins with."""
        return self.words.distinct

    def looked_up(self, hashes: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
        """Of each token (begins: which are the first of a text): ids, counts, chance; with pairs: node of the pair that it ends, a2, r2."""
        distinct, where = np.unique(hashes, return_inverse=True)
        ids, counts, chance = (x[where] for x in self.words.of(distinct))
        out = {"ids": ids, "counts": counts, "chance": chance}
        if self.pairs is not None:
            before = np.concatenate([[self.begin], ids[:-1]])
            before[begins] = self.begin
            # A word without an id may follow a context: only the context is looked up then, with an id that no word has.
            word = np.where(ids < 0, MOST_WORDS, ids)
            known = np.flatnonzero(before >= 0)
            key, back = np.unique((before[known].astype(_U) << _U(32)) | word[known].astype(_U), return_inverse=True)
            found = self.pairs.find((key >> _U(32)).astype(np.int64), (key & _U(0xFFFFFFFF)).astype(np.int64))
            for name, x, none in zip(("node", "a2", "r2"), found, (-1, 0.0, 1.0), strict=True):
                out[name] = np.full(len(ids), none)
                out[name][known] = x[back]
        return out

    def log10(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token given the two before in its text, and counts of the tokens."""
        out, counts = np.zeros(len(hashes)), np.zeros(len(hashes), np.int64)
        at = 0
        for h, begins, skip in pieces(hashes, first):
            t = self.looked_up(h, begins)
            chance = t["chance"]
            if self.pairs is not None:
                chance = t["a2"] + t["r2"] * chance
            if self.threes is not None:
                before = np.concatenate([[-1], t["node"][:-1]])
                before[begins] = -1  # the begin alone is known there
                known = np.flatnonzero(before >= 0)
                word = np.where(t["ids"] < 0, MOST_WORDS, t["ids"])[known]
                order = np.lexsort((word, before[known]))
                c, w = before[known][order], word[order]
                new, back = _runs(c, w)
                _, a, r = self.threes.find(c[new], w[new])
                there = known[order]
                chance[there] = a[back] + r[back] * chance[there]
            n = len(h) - skip
            out[at : at + n], counts[at : at + n] = np.log10(chance[skip:]), t["counts"][skip:]
            at += n
            _release()
        return out, counts


def train(docs: DataFrame, text: str = "text", folder: str | None = None) -> Trie:
    """A model of all texts of docs (null: empty, which is one end). No texts give a model that knows nothing.

    Three passes: words, then pairs by the words' ids, then threes by the pairs' nodes; each is counted in its tasks, summed by shard and stored there. A context, however
    frequent, comes to its shard as counts of distinct successors. Only a row for each shard comes to the driver. More distinct tokens than ids of 32 bits are an error.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or shared_dir(spark, "ngrams")
    docs = docs.select(col(text))
    tasks = docs.rdd.getNumPartitions()
    shards = min(MOST_SHARDS, max(8, tasks))

    def word_keys(hashes: np.ndarray, begins: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        return shard_of(hashes[skip:], shards), hashes[skip:]

    def save_words(s: int, k: np.ndarray, n: np.ndarray) -> tuple[str, int, int]:
        return _save(folder, _named(EliasFano.parts(k - _U(shard_start(s, shards))), "hashes") | {"counts": n}), len(k), int(n.sum())

    rows = _store(_count(docs, word_keys), tasks, shards, save_words).collect()
    words = Words(folder, {r.shard: r.name for r in rows}, {r.shard: r.size for r in rows}, sum(r.total for r in rows), shards)
    trie = Trie(words)

    # A key is a context's number in its shard and a word's id, as close as may be, so that their differences are small.
    bits = _U(max(1, words.distinct.bit_length()))
    # The begin of a text is the last context of the last shard.
    ends = words.base.copy()
    ends[-1] += 1

    def pair_keys(hashes: np.ndarray, begins: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        ids = trie.looked_up(hashes, begins)["ids"]
        before = np.concatenate([[trie.begin], ids[:-1]])
        before[begins] = trie.begin
        ids, before = ids[skip:], before[skip:]
        shard = np.searchsorted(ends, before, "right") - 1
        return shard, ((before - ends[shard]).astype(_U) << bits) | ids.astype(_U)

    def save_level(begins: np.ndarray, kinds_of: bool):
        if int(np.diff(begins).max()).bit_length() + int(bits) > 64:
            raise ValueError("a shard has too many contexts: more shards are needed")

        def save(s: int, k: np.ndarray, n: np.ndarray) -> tuple[str, int, int]:
            local, word = (k >> bits).astype(np.int64), (k & ((_U(1) << bits) - _U(1))).astype(np.int64)
            arrays = _level_arrays(local, word, n, int(begins[s + 1] - begins[s]))
            if kinds_of:  # of how many contexts in this shard each word is a successor
                each, kinds = np.unique(word, return_counts=True)
                arrays |= {"words": each.astype(np.uint32), "kinds": kinds.astype(np.uint32)}
            return _save(folder, arrays), len(k), int(n.sum())

        return save

    rows = _store(_count(docs, pair_keys), tasks, shards, save_level(ends, True)).collect()
    trie.pairs = Level(folder, ends, {r.shard: r.name for r in rows}, {r.shard: r.size for r in rows})
    words.kinds = int(trie.pairs.base[-1])
    files = [(r.shard, r.name) for r in rows]

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, name in zip(*(x.to_pylist() for x in b.columns), strict=True):
                arrays = _open(folder, name)
                shard = np.searchsorted(words.base, arrays["words"], "right") - 1
                yield _packed(shard, arrays["words"].astype(_U) - words.base[shard].astype(_U), arrays["kinds"].astype(np.int64), s)

    def save_chances(s: int, k: np.ndarray, n: np.ndarray) -> tuple[str, int, int]:
        every = np.zeros(int(words.base[s + 1] - words.base[s]), np.int64)
        every[k.astype(np.int64)] = n
        codes, table = _chances(words.chance(every))
        return _save(folder, {"codes": codes, "table": table}), len(k), int(n.sum())

    if files:
        told = spark.createDataFrame(files, "shard int, name string").repartition(shards, even_slot(spark, F.col("shard"), shards))
        rows = _store(told.mapInArrow(kinds, _PACKED_DDL), len(files), shards, save_chances).collect()
        words.chances = {r.shard: r.name for r in rows}

        # Shards of threes are equal ranges of the nodes of pairs, so that the pairs of one frequent word spread over several.
        nodes = int(trie.pairs.base[-1])
        ranges = np.array([nodes * s // shards for s in range(shards + 1)])

        def three_keys(hashes: np.ndarray, begins: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
            t = trie.looked_up(hashes, begins)
            at = skip + np.flatnonzero(~begins[skip:])
            before = t["node"][at - 1]
            shard = np.searchsorted(ranges, before, "right") - 1
            return shard, ((before - ranges[shard]).astype(_U) << bits) | t["ids"][at].astype(_U)

        rows = _store(_count(docs, three_keys), tasks, shards, save_level(ranges, False)).collect()
        trie.threes = Level(folder, ranges, {r.shard: r.name for r in rows}, {r.shard: r.size for r in rows})
    return trie


def score(df: DataFrame, model: Trie, text: str = "text") -> DataFrame:
    """Adds n_tokens (ends included), n_known (tokens that training had), train_tokens, base_score (log10 by single words) and score (log10 by the model).

    Texts are whole; null is empty, one end. Repeated rows give repeated results; an empty table gives none. Columns of the input stay, but for
    those whose names are new ones'.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # names of files: some bytes a shard
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = kept(df, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for table, column in _columns(batches, text):
            hashes, first = token_hashes(column)
            log10, counts = trie.log10(hashes, first)
            sums = lambda x: np.add.reduceat(x, first[:-1]) if len(column) else np.zeros(0)  # noqa: B023, E731
            new = [pa.array(np.diff(first), pa.int64()), pa.array(sums((counts > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(column), trie.words.tokens), pa.int64()), pa.array(sums(trie.words.log10(counts)), pa.float64()), pa.array(sums(log10), pa.float64())]
            table = table.select(keep)
            for name, x in zip(names, new, strict=True):
                table = table.append_column(name, x)
            yield from table.combine_chunks().to_batches()

    fields = [df.schema[c] for c in keep] + [T.StructField(n, T.LongType() if i < 3 else T.DoubleType()) for i, n in enumerate(names)]
    return df.select(*map(col, dict.fromkeys([*keep, text]))).mapInArrow(run, T.StructType(fields))


def held_out(key: Column) -> Column:
    """A tenth of the rows, by the checksum of the key as text; a null key is trained on."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 10 == 0, F.lit(False))

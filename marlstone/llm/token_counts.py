"""Token counts of a sentencepiece model without tokenizing every text.

A map-side two-tier lookup. A word with the spaces before it (a pre-token) never shares a piece with its neighbours, so that
the tokens of a text are those of its pre-tokens, added up. First tier: a table of the lengths of frequent pre-tokens, broadcast
to all workers; its size is bounded by its capacity and the longest word it takes. Second tier: each worker encodes the
pre-tokens that the table lacks and keeps their lengths in a cache of bounded size. No pre-token is ever shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlstone.llm.common import kept, small_batches, texts, with_arrays

#: A longer pre-token is encoded where it stands; it is in neither tier.
LONGEST = 64
_RUNS = re.compile(" *[^ ]+| +$")
_WORKER: dict = {}


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text, each without its first space: what sentencepiece puts before a text stands for that.

    U+2581 is what the library writes for a space. Runs of spaces belong to the word that follows, or make up one at the end.
    """
    if not text:
        return []
    text = text.replace("▁", " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [x[1:] for x in _RUNS.findall(" " + text)]


def additive(model_path: str) -> bool:
    """Whether the model's counts may be added up over pre-tokens: spaces only begin pieces, and texts are taken as they are."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(model_path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
    return bool(plain and not model.trainer_spec.treat_whitespace_as_suffix and all(p.type != 4 and "▁" not in p.piece.lstrip("▁") for p in model.pieces))


def _processor(model_path: str):
    if _WORKER.get("path") != model_path:
        import sentencepiece

        _WORKER.clear()
        _WORKER.update(path=model_path, sp=sentencepiece.SentencePieceProcessor(model_file=model_path))
    return _WORKER["sp"]


def lengths(sp, words: list[str]) -> list[int]:
    """Tokens of each pre-token. The empty one is a single space at the end of a text, which the library gives tokens only after something."""
    return [len(x) if w else len(sp.encode("a ")) - len(sp.encode("a")) for w, x in zip(words, sp.encode(words, num_threads=1), strict=True)]


def _cut(counts: Counter, capacity: int) -> Counter:
    """The capacity largest counts, less the largest that goes (the step of Misra and Gries, so that sketches add up)."""
    if len(counts) <= capacity:
        return counts
    top = counts.most_common(capacity + 1)
    return Counter({w: n - top[-1][1] for w, n in top[:-1] if n > top[-1][1]})


def _sketch_rows(counts: Counter, capacity: int) -> pa.RecordBatch:
    top = _cut(counts, capacity)
    return pa.RecordBatch.from_pydict({"words": [list(top)], "counts": [list(top.values())]}, schema=_SKETCH)


_SKETCH = pa.schema([("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def frequent_pre_tokens(df: DataFrame, text: str = "text", capacity: int = 16384) -> list[str]:
    """Pre-tokens that are frequent over all texts. Each task keeps a sketch of bounded size; sketches are merged 32 at a time."""
    small_batches(df.sparkSession)
    schema = "words array<string>, counts array<bigint>"

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            own: Counter = Counter()
            for t in texts(b, text):
                own.update(pre_tokens(t))
            counts.update({w: n for w, n in own.items() if len(w) <= LONGEST})  # what the table never takes isn't kept
            if len(counts) > 16 * capacity:
                counts = _cut(counts, 4 * capacity)
        yield _sketch_rows(counts, capacity)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for words, ns in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.update(dict(zip(words, ns, strict=True)))
                counts = _cut(counts, 4 * capacity)
        yield _sketch_rows(counts, capacity)

    out = df.select(text).mapInArrow(sketch, schema)
    parts = out.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // 32)
        out = out.repartition(parts).mapInArrow(merge, schema)
    rows = out.collect()
    counts: Counter = Counter()
    for r in rows:
        counts.update(dict(zip(r.words, r.counts, strict=True)))
    return [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:capacity]]


def count_tokens(df: DataFrame, model_path: str, text: str = "text", limit: int = 4096, capacity: int = 16384, cache: int = 400_000) -> DataFrame:
    """Adds n_bytes (UTF-8 length), n_tokens and over_limit (n_tokens > limit) to every row.

    Texts are whole; null is empty and has 0 tokens. Rows are independent: repeated rows give repeated results, an empty table
    gives none. Columns of the input stay, but for those whose names are new ones'. model_path is a file that each worker can
    read. For a model whose counts can't be added up over pre-tokens, every text is encoded whole.
    """
    spark = df.sparkSession
    small_batches(spark)
    adds = additive(model_path)
    hot = None
    if adds:
        words = frequent_pre_tokens(df, text, capacity)
        sizes = np.array(lengths(_processor(model_path), words), "<u2") if words else np.zeros(0, "<u2")  # LONGEST characters have four bytes each, a token a byte at most
        hot = spark.sparkContext.broadcast(("\n".join(w.replace("\n", "▁") for w in words), sizes.tobytes()))  # no pre-token holds U+2581
    keep = kept(df, ["n_bytes", "n_tokens", "over_limit"])
    columns = list(dict.fromkeys([*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(model_path)
        first: dict[str, int] = {}
        if adds and hot.value[0]:
            first = dict(zip((w.replace("▁", "\n") for w in hot.value[0].split("\n")), np.frombuffer(hot.value[1], "<u2").tolist(), strict=True))
        known = dict(first)
        for b in batches:
            whole = texts(b, text)
            if adds:
                split = [pre_tokens(t) for t in whole]
                new: set[str] = set().union(*split).difference(known) if split else set()
                misses = list(new)
                known.update(zip(misses, lengths(sp, misses), strict=True))
                counts = [sum(map(known.__getitem__, x)) for x in split]
                if len(known) > cache + len(first):
                    known = dict(first)
                elif new:
                    for w in [w for w in misses if len(w) > LONGEST]:
                        del known[w]
            else:
                counts = [len(x) for x in sp.encode(whole, num_threads=1)]
            yield with_arrays(b, {"n_bytes": pa.array([len(t.encode("utf-8", "surrogatepass")) for t in whole], pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "over_limit": pa.array([n > limit for n in counts], pa.bool_())}, keep)

    fields = [df.schema[c] for c in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return df.select(*columns).mapInArrow(run, T.StructType(fields))

"""Byte-level BPE with the tiktoken library and a local rank file.

Token ids are packed: a binary column of little-endian unsigned 32-bit integers. Long texts are cut at safe boundaries before they are encoded, so that the library
meets pieces of bounded size; the ids are those of the whole text. What has no such boundary, a run of one kind of characters (letters without an end, blanks only), is one
piece however long: it is one match of the pattern, which has to be encoded as one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlstone.llm.common import kept, small_batches, texts, with_arrays

#: A text longer than this many characters is cut.
PIECE = 65_536
#: Places where a match always ends and the next begins, as no match of the pattern goes on over them and none looks back: before white space; between letters and digits; between
#: letters or digits and common marks, but for an apostrophe, which may begin a match with the letters that follow.
_LETTER = "A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff"
_MARK = ".,;:!?()\u3001\u3002\uff01\uff0c\uff1f\u300c\u300d"
_SAFE = re.compile(f"[^\\s\x1c-\x1f](?=[ \\t\\n\\r\u3000])|[{_LETTER}](?=[0-9{_MARK}])|[0-9](?=[{_LETTER}{_MARK}])|[{_MARK}](?=[0-9{_LETTER}])")
_WORKER: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encoder(ranks_path: str, pattern: str):
    """One encoder a worker process."""
    key = (ranks_path, pattern)
    if _WORKER.get("key") != key:
        import tiktoken

        _WORKER.clear()
        _WORKER.update(key=key, enc=tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={}))
    return _WORKER["enc"]


def cut(text: str, size: int = PIECE) -> Iterator[str]:
    """Pieces of a text, cut at the first safe boundary after each size characters; they join to the text."""
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def encode_one(enc, text: str) -> np.ndarray:
    if len(text) <= PIECE:
        return np.array(enc.encode_ordinary(text), "<u4")
    return np.concatenate([np.array(enc.encode_ordinary(x), "<u4") for x in cut(text)])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds n_tokens and token_ids (packed) to every row.

    Texts are whole; null is empty and has no ids. Strings of special tokens are ordinary text. Repeated rows give repeated results,
    an empty table gives none. Columns of the input stay, but for those whose names are new ones'.
    """
    small_batches(df.sparkSession)
    keep = kept(df, ["n_tokens", "token_ids"])
    columns = list(dict.fromkeys([*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for b in batches:
            ids = [encode_one(enc, t) for t in texts(b, text)]
            yield with_arrays(b, {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "token_ids": pa.array([x.tobytes() for x in ids], pa.binary())}, keep)

    fields = [df.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())]
    return df.select(*columns).mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, ranks_path: str, token_ids: str = "token_ids") -> DataFrame:
    """Adds decoded, the raw bytes of packed ids. Null ids give null. An id that the rank file lacks is an error.

    Bytes, not text: ids may end inside a character. Columns of the input stay, but for one named decoded.
    """
    small_batches(df.sparkSession)
    keep = kept(df, ["decoded"])
    columns = list(dict.fromkeys([*keep, token_ids]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {i: b for b, i in read_ranks(ranks_path).items()}
        for b in batches:
            out = [None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in b.column(token_ids).to_pylist()]
            yield with_arrays(b, {"decoded": pa.array(out, pa.binary())}, keep)

    fields = [df.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType())]
    return df.select(*columns).mapInArrow(run, T.StructType(fields))

"""Licence scans by a positional index of rare template words.

Templates are the passages of licences and notices. Their words are the index's vocabulary; a posting is (template, position). How many documents hold each such word is
counted over the whole corpus, which gives its IDF. For a document, the words of highest IDF that it shares with a template are looked up; all their postings vote for the
place where the template would begin, and places that enough of these words agree on, within some words put in or left out, are alignments. An alignment becomes a label if
the template's mandatory phrase stands there and at least half of the template's words stand in their order; the score is that share. Phrases that stand on
their own (base labels) are found in every text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import LOWER_BYTE, WORD, WORD_BYTE, col, kept, lower_ascii, small_batches, texts, with_arrays
from marlstone.llm.licence_texts import BASE, PASSAGES

#: Words of highest IDF that vote for a template; how far two of them may slip against each other; least share of votes, and of words in order.
RAREST, SLACK, LEAST_SHARE = 24, 3, 0.5

_WORD = re.compile(WORD)


class Index:
    """Template words, their postings, and how rare they are in a corpus of n documents."""

    def __init__(self, counts: dict[str, int] | None = None, n: int = 0):
        self.templates = [(label, _WORD.findall(lower_ascii(text)), phrase.split()) for label, text, phrase in PASSAGES]
        self.postings: dict[str, list[tuple[int, int]]] = {}
        for t, (_, words, _) in enumerate(self.templates):
            for at, w in enumerate(words):
                self.postings.setdefault(w, []).append((t, at))
        counts = counts or {}
        self.idf = {w: float(np.log((n + 1) / (counts.get(w, 0) + 1))) for w in self.postings}
        self.rare = [sorted(set(words), key=lambda w: (-self.idf[w], w)) for _, words, _ in self.templates]

    def vocabulary(self) -> list[str]:
        return sorted(self.postings)


def alignments(words: list[str], index: Index) -> list[tuple[int, int, float]]:
    """(template, where it begins in the words, share of its words that stand in their order) for every verified alignment."""
    where: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if w in index.postings:
            where.setdefault(w, []).append(i)
    found = []
    for t, (_, text, phrase) in enumerate(index.templates):
        if not all(w in where for w in phrase):
            continue
        own = [w for w in index.rare[t] if w in where][:RAREST]
        least = max(2, LEAST_SHARE * min(RAREST, len(index.rare[t])))
        if len(own) < least:
            continue
        votes = sorted((i - at, w) for w in own for x, at in index.postings[w] if x == t for i in where[w])
        taken: list[int] = []
        for start in _agreed(votes, least):
            if any(abs(start - s) < len(text) for s in taken):
                continue  # another place of the same alignment
            low = max(0, start - SLACK)
            near = words[low : max(0, start + len(text) + SLACK)]
            if _holds(near, phrase) and (share := in_order(text, near) / len(text)) >= LEAST_SHARE:
                found.append((t, start, share))
                taken.append(start)
    return found


def _agreed(votes: list[tuple[int, str]], least: float) -> list[int]:
    """Places that at least so many distinct words vote for within SLACK, the most agreed on first."""
    inside: Counter = Counter()
    best: dict[int, int] = {}
    lo = 0
    for hi, (start, w) in enumerate(votes):
        inside[w] += 1
        while votes[lo][0] < start - SLACK:
            inside[votes[lo][1]] -= 1
            if not inside[votes[lo][1]]:
                del inside[votes[lo][1]]
            lo += 1
        if len(inside) >= least:
            middle = votes[(lo + hi) // 2][0]
            best[middle] = max(best.get(middle, 0), len(inside))
    return sorted(best, key=lambda s: (-best[s], s))


def in_order(text: list[str], near: list[str]) -> int:
    """Words of the text that stand in these words in its order: the longest common subsequence."""
    at: dict[str, list[int]] = {}
    for p in range(len(text) - 1, -1, -1):
        at.setdefault(text[p], []).append(p)
    ends: list[int] = []  # the least last position of a chain of each length
    for w in near:
        for p in at.get(w, ()):  # from the last on, so that a word extends a chain once
            i = bisect_left(ends, p)
            ends[i : i + 1] = [p]
    return len(ends)


def _holds(words: list[str], phrase: list[str]) -> bool:
    n = len(phrase)
    return any(words[i : i + n] == phrase for i in range(len(words) - n + 1))


def scan_text(text: str, index: Index) -> tuple[int, int | None, int | None, list[str], list[str], float]:
    """n_base, first_word, last_word, base labels, all labels, score of a text that may hold a licence."""
    words = _WORD.findall(lower_ascii(text))
    places: list[int] = []
    base: set[str] = set()
    for phrase, label in BASE.items():
        p = phrase.split()
        for i in [i for i, w in enumerate(words) if w == p[0]]:
            if words[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    hits = alignments(words, index)
    labels = base | {index.templates[t][0] for t, _, _ in hits}
    score = max((s for _, _, s in hits), default=0.5 if base else 0.0)
    return len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(labels), float(score)


def count_words(column: pa.Array) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Words in each text of a string array, by bytes; the lower-cased bytes of all texts, and where each text begins in them."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = WORD_BYTE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[starts] = inside[starts]
    total = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]], LOWER_BYTE[data].tobytes(), offsets


def licence_word_counts(df: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """How many documents hold each template word (as a word), and how many documents there are. Each task returns one row a word at most."""
    small_batches(df.sparkSession)
    vocabulary = set(Index().vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            _, low, offsets = count_words(b.column(0))
            for i in range(len(offsets) - 1):
                # Bytes that aren't of words become blanks; a document's words are then its split.
                counts.update(vocabulary.intersection(low[offsets[i] : offsets[i + 1]].translate(_BLANKS).decode().split(" ")))
            counts[""] += b.num_rows
        yield pa.RecordBatch.from_pydict({"w": list(counts), "n": list(counts.values())}, schema=pa.schema([("w", pa.string()), ("n", pa.int64())]))

    rows = df.select(col(text)).mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()  # as many rows as template words
    counts = {r.w: r.n for r in rows}
    return counts, counts.pop("", 0)


_BLANKS = bytes(b if WORD_BYTE[b] else 32 for b in range(256))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels (sorted, joined by commas; none: empty) and score to every row.

    first_word and last_word are the smallest and the largest start of a base phrase, null if there is none. score is the best share of a template's words in
    their order; a base phrase without an alignment has 0.5, a text without either 0. Texts are whole; null is empty. Repeated rows give
    repeated results; an empty table gives none. Columns of the input stay, but for those whose names are new ones'.
    """
    small_batches(df.sparkSession)
    counts, n = licence_word_counts(df, text)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [T.LongType(), T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.DoubleType()]
    keep = kept(df, names)
    columns = list(dict.fromkeys([*keep, text]))
    # A template's alignment holds its mandatory phrase, a base label its own; a text without the longest word of any is done once its words are counted.
    needed = sorted({max(p.split(), key=len).encode() for p in [*BASE, *(phrase for _, _, phrase in PASSAGES)]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(counts, n)
        find = re.compile(b"|".join(map(re.escape, needed))).search
        for b in batches:
            words, low, offsets = count_words(b.column(text))
            whole = texts(b, text)
            rows = [scan_text(whole[i], index) if find(low, offsets[i], offsets[i + 1]) else (0, None, None, [], [], 0.0) for i in range(b.num_rows)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            new = [pa.array(words, pa.int64()), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array([",".join(x) for x in c], pa.string()) for c in cols[3:5]], pa.array(cols[5], pa.float64())]
            yield with_arrays(b, dict(zip(names, new, strict=True)), keep)

    fields = [df.schema[c] for c in keep] + [T.StructField(a, t) for a, t in zip(names, types, strict=True)]
    return df.select(*map(col, columns)).mapInArrow(run, T.StructType(fields))

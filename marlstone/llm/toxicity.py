"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

A word is the set of its subsequences of three letters within SPAN letters, each of weight DECAY to the power of the letters that it skips (of several occurrences the
highest). The kernel of two words is the sum of the lesser of both weights, over their common subsequences, divided by a size of each word that doesn't grow beyond
that of LETTERS letters, to the power DEGREE: an intersection kernel, scaled, to a whole power, hence positive semidefinite. What else stands in a long word doesn't
lower it, and letters may stand between those of an insult; characters that aren't letters or digits inside a word are taken out first, and single letters in a row
make up one word. The begin of a word counts as a letter. Landmarks are pieces of words which toxic documents share, and the clean words that resemble them most; a word's kernel values with them, times the
inverse root of their kernel matrix, are its Nyström features. Two linear support vector machines are trained on them. One takes sentences, which have the margin of their
highest word: all sentences of clean documents are negative; of a toxic document those are positive that have a word which tells toxic documents (twenty times as frequent
there), or, if it has none, its highest one, which is found anew in each round. Positive words are also given with letters put between theirs. It finds words that are insults wherever they stand. The other takes the mean features of all words of a document: it finds words
that clean documents have too, but less often. A logistic turns each margin, the highest of a text's sentences and that of its mean, into a probability at the shares that
the labels have, and the higher one is the score.
"""

from __future__ import annotations

import heapq
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import col, kept, lower_ascii, small_batches, texts, with_arrays

#: Letters of a subsequence are within SPAN letters; each letter that it skips counts DECAY. The size of a word is that of LETTERS letters at most; the kernel's power.
SPAN, DECAY, LETTERS, DEGREE = 9, 0.95, 5, 3
#: Labelled documents that the model is fitted on: at most so many of each label, and of each at most those of so many bytes in all.
MOST_DOCS, MOST_BYTES = 3000, 16 << 20
#: Landmarks of toxic documents and of clean ones at most; lengths of the pieces; how many landmarks each toxic document should have.
TOXIC_LANDMARKS, CLEAN_LANDMARKS, LENGTHS, COVER = 128, 32, (7, 6, 5, 4), 3
#: Clean words that join the machine's working set in a round (the highest of those that it gets wrong), and rounds.
WORKING, ROUNDS = 1500, 6
#: Words without a sign that the mean of a text has besides its own, so that one word of a short text isn't much.
PRIOR = 20
#: Score from which a document is predicted to be toxic.
CUT = 0.7
#: Words, and letters, that are looked at at once.
STEP, STEP_LETTERS = 512, 1 << 16
#: The begin of a word, and a letter that no word has.
BEGIN, NONE = "\2", "\1"

_SENTENCE = re.compile(r"(?<=[.!?])\s|\n")
#: From the lowest weight on.
_TRIPLES = [(i, j) for j in range(SPAN - 1, 1, -1) for i in range(1, j)]


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(lower_ascii(text)) if s and not s.isspace()]


def bare(word: str) -> str:
    """A word without the characters that aren't letters or digits."""
    return word if word.isalnum() else "".join(c for c in word if c.isalnum())


def words(sentence: str) -> list[str]:
    """What stands between blanks in a sentence; each run of single letters or digits is one more word."""
    out = sentence.split()
    run = ""
    for w in [bare(w) for w in out] + ["", ""] if _SPACED.search(sentence) else ():
        if len(w) == 1:
            run += w
        else:
            if len(run) > 2:
                out.append(run)
            run = ""
    return out


#: Three letters or more that stand alone.
_SPACED = re.compile(r"(?<!\S)\w(?:\s\w){2,}(?!\S)")


def weight(skipped: int) -> float:
    """Of a subsequence that skips so many letters."""
    return DECAY**skipped


def _size(letters: int) -> float:
    """The root of the weight of all subsequences of so many letters, LETTERS at most."""
    n = min(max(letters, 3), LETTERS)
    return sum((n - j) * weight(j - 2) for i, j in _TRIPLES if j < n) ** 0.5


_SIZES = [_size(n) for n in range(LETTERS + 1)]


def _steps(units: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of words of bounded number and length."""
    lo = letters = 0
    for i, u in enumerate(units):
        if i > lo and (i - lo == STEP or letters + len(u) > STEP_LETTERS):
            yield lo, i
            lo, letters = i, 0
        letters += len(u)
    if lo < len(units):
        yield lo, len(units)


class Landmarks:
    """Landmark words by the weights of their subsequences: a row for each subsequence that one of them has. Letters that none of them has are 0."""

    def __init__(self, units: list[str]):
        self.units = units
        letters = sorted({c for u in units for c in u})[:254]  # symbols are bytes
        self.base = len(letters) + 1
        self.symbols = np.zeros(0x110000, np.uint8)
        self.symbols[[ord(c) for c in letters]] = np.arange(1, self.base)
        found = [c[(c % self.base > 0) & (c // self.base % self.base > 0) & (c >= self.base**2)] for c, _, _ in self._codes(units)]
        known = np.unique(np.concatenate(found))
        self.row_of = np.full(self.base**3, len(known), np.int32)  # the last row: what none of them has
        self.row_of[known] = np.arange(len(known))
        self.sizes = np.array([_size(len(u)) for u in units])
        who, row, weight = self._shared(units)
        order = np.lexsort((who, row))
        #: By subsequence the landmarks that have it, one after the other, and the weights there.
        self.starts = np.searchsorted(row[order], np.arange(len(known) + 1))
        self.holders, self.held = who[order], weight[order]
        self.gram = self.kernel(units).astype(np.float64)

    def _codes(self, units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """For each form of a subsequence, from the lowest weight on: codes, the words they are in, and the weight."""
        gap = "\0" * (SPAN - 1)  # so far apart that no subsequence goes from one word to the next
        points = np.frombuffer((gap.join(units) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = self.symbols[points].astype(np.int32)
        owner = np.repeat(np.arange(len(units)), [len(u) + SPAN - 1 for u in units])
        n = len(row) - SPAN + 1
        first, second = row * (self.base * self.base), row * self.base
        for i, j in _TRIPLES:
            yield first[:n] + second[i : i + n] + row[j : j + n], owner[:n], weight(j - 2)

    def _shared(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, the subsequences of landmarks that they have, and the highest weight of each there."""
        rows = int(self.row_of.max())  # what no landmark has is one more row
        keys, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
        for code, who, w in self._codes(units):
            row = self.row_of[code]
            hit = np.flatnonzero(row < rows)
            keys.append(who[hit] * rows + row[hit])
            weights.append(np.full(len(hit), w))
        key, weight = np.concatenate(keys), np.concatenate(weights)
        key, last = np.unique(key[::-1], return_index=True)  # higher weights come later
        return key // rows, key % rows, weight[::-1][last]

    def kernel(self, units: list[str]) -> np.ndarray:
        """Kernel values of words with each landmark, a row for each word."""
        out = np.zeros((len(units), len(self.units)), np.float32)
        for lo, hi in _steps(units):
            who, row, weight = self._shared(units[lo:hi])
            n = self.starts[row + 1] - self.starts[row]
            at = np.repeat(self.starts[row] - np.cumsum(n) + n, n) + np.arange(n.sum())
            pair = np.repeat(who, n) * len(self.units) + self.holders[at]
            out[lo:hi] = np.bincount(pair, np.minimum(np.repeat(weight, n), self.held[at]), (hi - lo) * len(self.units)).reshape(hi - lo, -1)
        size = np.array([_SIZES[min(len(u), LETTERS)] for u in units])
        return (out / (size[:, None] * self.sizes).astype(np.float32)) ** DEGREE


@dataclass
class Model:
    """A fitted model: weights on kernel values with the landmarks (the map and a machine in one), and the logistic."""

    landmarks: Landmarks
    weights: np.ndarray  # a column for each machine
    bias: float  # of the first
    logistic: tuple  # slope and shift for each machine

    def margins(self, units: list[str]) -> np.ndarray:
        """Of bare words: the first machine's margin, the second's part of a mean."""
        return self.landmarks.kernel(units) @ self.weights + np.array([self.bias, 0], np.float32)

    def probability(self, highest: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """The higher one of both machines' probabilities."""
        each = [1 / (1 + np.exp(-np.clip(a * x + b, -30, 30))) for (a, b), x in zip(self.logistic, (highest, mean), strict=True)]
        return np.maximum(*each)


class Scorer:
    """Margins of words and texts; keeps the margins of words (a bounded number), since most words recur."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most = model, most
        self.high: dict[str, float] = {}
        self.part: dict[str, float] = {}

    def learn(self, new: Iterable[str]) -> None:
        fresh = list(new)
        plain = [bare(w) for w in fresh]
        self.high.update(dict.fromkeys(fresh, self.model.bias))
        self.part.update(dict.fromkeys(fresh, 0.0))
        some = [i for i, w in enumerate(plain) if len(w) > 2]
        for lo in range(0, len(some), 8192):
            part = some[lo : lo + 8192]
            found = self.model.margins([BEGIN + plain[i] for i in part])
            for column, known in enumerate((self.high, self.part)):
                known.update(zip((fresh[i] for i in part), found[:, column].tolist(), strict=True))

    def scores(self, docs: list[str]) -> np.ndarray:
        """Probabilities of texts. A text without words has the first machine's bias and a mean of 0."""
        if len(self.high) > self.most:
            self.high, self.part = {}, {}
        low = [lower_ascii(t) for t in docs]
        own = [words(t) for t in low]
        self.learn(set().union(*own).difference(self.high))
        highest = [max(self.model.bias, max(map(self.high.__getitem__, w), default=self.model.bias)) for w in own]
        mean = [sum(map(self.part.__getitem__, w)) / (len(w) + PRIOR) for w in own]
        return self.model.probability(np.array(highest, float), np.array(mean, float))


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 40, seed: int = 7) -> np.ndarray:
    """Weights of a linear support vector machine (the last is the bias), by dual coordinate descent; each row has a cost of its own."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)], dtype=np.float64)
    square = np.einsum("ij,ij->i", x, x)
    alpha, w, rng = np.zeros(len(y)), np.zeros(x.shape[1]), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]) / cost[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def _platt(m: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of the logistic of least loss, with the smoothed targets of Platt, by Newton steps; the labels weigh as `share` of toxic ones has them."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y > 0, share / pos, (1 - share) / neg) * len(y)
    scale = max(float(m.std()), 1e-9)
    x = np.stack([m / scale, np.ones(len(m))], 1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - t)) + 1e-3 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 2.0 / max(1e-9, abs(step).max()))
        if abs(step).max() < 1e-6:
            break
    return float(max(w[0] / scale, 0.0)), float(w[1])


def _pieces(word: str) -> set[str]:
    return {word[i : i + n] for n in LENGTHS for i in range(len(word) - n + 1)}


def choose_landmarks(names: list[str], owned: list[np.ndarray], times: list[np.ndarray], y: np.ndarray) -> list[str]:
    """Pieces of words that mark toxic documents, each chosen for the most documents that lack COVER of them yet; then the clean words most like them.

    Documents are given as the numbers of their words among the names, and how often each stands there. A piece marks toxic documents if it is twenty times as frequent there.
    """
    n_pos, n_neg = int((y > 0).sum()), int((y < 0).sum())
    clean, rare = (_tally(owned, times, y, sign, len(names)) for sign in (-1, 1))
    least = max(2, 0.01 * n_pos)
    # Most pieces are in a document or two: sets are kept only for those that may be in enough, by counts of hashes, which are never too small.
    bins = np.zeros(1 << 20, np.int64)
    for w in np.flatnonzero(rare).tolist():
        for g in _pieces(names[w]):
            bins[hash(g) % len(bins)] += rare[w]
    enough = {w: some for w in np.flatnonzero(rare).tolist() if (some := [g for g in _pieces(names[w]) if bins[hash(g) % len(bins)] >= least])}
    holders: dict[str, set[int]] = {}
    often: Counter = Counter()
    toxic = np.flatnonzero(y > 0).tolist()
    for i in toxic:
        for w, n in zip(owned[i].tolist(), times[i].tolist(), strict=True):
            for g in enough.get(w, ()):
                holders.setdefault(g, set()).add(i)
                often[g] += n
    del enough
    holders = {g: h for g, h in holders.items() if len(h) >= least}
    against: Counter = Counter()
    for w in np.flatnonzero(clean).tolist():
        for g in _pieces(names[w]):
            if g in holders:
                against[g] += int(clean[w])
    ratio = {g: np.log(often[g] / n_pos) - np.log((against[g] + 0.1) / n_neg) for g in holders}
    open_ = {g: h for g, h in holders.items() if ratio[g] > 3}
    lacks, chosen = Counter(dict.fromkeys(toxic, COVER)), []
    heap = [(-len(h), -len(g), g) for g, h in open_.items()]
    heapq.heapify(heap)
    while heap and len(chosen) < TOXIC_LANDMARKS:
        worth, n, g = heapq.heappop(heap)
        now = sum(lacks[i] > 0 for i in open_[g])
        if now < -worth:  # others have covered some of its documents since
            if now > 1:
                heapq.heappush(heap, (-now, n, g))
            continue
        chosen.append(g)
        lacks.subtract(i for i in open_[g] if lacks[i] > 0)
    for w in telling(clean, rare, least, n_pos, n_neg):  # each word that tells toxic documents has a landmark of its own
        if len(chosen) < TOXIC_LANDMARKS and not any(g in names[w] for g in chosen) and (own := _pieces(names[w]) & open_.keys()):
            chosen.append(max(own, key=lambda g: (len(open_[g]), len(g), g)))
    if not chosen:
        chosen = [names[w] for w in sorted(np.flatnonzero(rare).tolist(), key=lambda w: (clean[w], names[w]))[:8]] or [BEGIN + "none"]
    near = np.where(clean > 0, _closeness(Landmarks(chosen), names), -1)
    like = sorted(np.argsort(-near, kind="stable")[: 4 * CLEAN_LANDMARKS].tolist(), key=lambda w: (-near[w], names[w]))[:CLEAN_LANDMARKS]
    return list(dict.fromkeys([*chosen, *(names[w] for w in like if near[w] >= 0)]))


def telling(clean: np.ndarray, toxic: np.ndarray, least: float, n_pos: int, n_neg: int) -> list[int]:
    """Words that enough toxic documents have, and that are twenty times as frequent there; the most frequent first."""
    some = np.flatnonzero((toxic >= least) & (toxic / n_pos > 20 * (clean + 0.1) / n_neg))
    return some[np.argsort(-toxic[some], kind="stable")].tolist()


def _tally(owned: list[np.ndarray], times: list[np.ndarray], y: np.ndarray, sign: int, n: int) -> np.ndarray:
    """How often each word stands in the documents of a label."""
    out = np.zeros(n, np.int64)
    for o, t, label in zip(owned, times, y, strict=True):
        if label == sign:
            out[o] += t  # a document's words are distinct
    return out


def marked(units: list[str]) -> list[str]:
    """Bare words of three letters or more, with their begin."""
    return [BEGIN + w for w in map(bare, units) if len(w) > 2]


def _closeness(marks: Landmarks, names: list[str]) -> np.ndarray:
    """Of each word the highest kernel value with a landmark, as a part of the landmark's own."""
    own = np.diag(marks.gram).astype(np.float32)
    return np.concatenate([(marks.kernel(names[lo : lo + 8192]) / own).max(1) for lo in range(0, len(names), 8192)] or [np.zeros(0)])


def filled(word: str) -> list[str]:
    """The word with letters put between its own: one in every gap, two in every second. The letters are ones that no landmark has."""
    return [NONE.join(word).replace(BEGIN + NONE, BEGIN), "".join(c + NONE * 2 * (i > 0 and i % 2 == 0) for i, c in enumerate(word))]


def fit(docs: list[str], toxic: list[int], share: float | None = None) -> Model:
    """A model of labelled texts; share is that of toxic ones among all labels (null: as given). With texts of one label only, or none, all scores are that label's share (smoothed)."""
    y = np.array([1 if t else -1 for t in toxic])
    if not len(y) or abs(y.sum()) == len(y):
        share = (sum(1 for t in toxic if t) + 1) / (len(toxic) + 2)
        return Model(Landmarks([BEGIN + "none"]), np.zeros((1, 2), np.float32), 0.0, ((0.0, float(np.log(share / (1 - share)))),) * 2)
    number: dict[str, int] = {}
    owned, times, length = [], [], []
    for t in docs:
        all_ = words(lower_ascii(t))
        length.append(len(all_))
        counts = Counter(marked(all_))
        owned.append(np.array([number.setdefault(w, len(number)) for w in counts], np.int32))
        times.append(np.array(list(counts.values()), np.int32))
    names = list(number)
    del number
    marks = Landmarks(choose_landmarks(names, owned, times, y))
    once = [np.ones(len(o), np.int64) for o in owned]
    in_clean, in_toxic = (_tally(owned, once, y, sign, len(names)) for sign in (-1, 1))
    n_pos, n_neg = int((y > 0).sum()), int((y < 0).sum())
    told = {w: int(in_toxic[w]) for w in telling(in_clean, in_toxic, max(2, 0.01 * n_pos), n_pos, n_neg)}
    silent = [o for o, label in zip(owned, y, strict=True) if label > 0 and len(o) and not any(w in told for w in o.tolist())]
    # Nyström: features K^-1/2 k(x).
    value, vector = np.linalg.eigh(marks.gram + 1e-2 * np.eye(len(marks.gram)))
    white = (vector / np.sqrt(value)) @ vector.T
    blocks = [(lo, min(lo + 8192, len(names))) for lo in range(0, len(names), 8192)]
    # Kernel values of all words, once, in half precision: two bytes a word and landmark.
    values = np.zeros((len(names), len(marks.units)), np.float16)
    for lo, hi in blocks:
        values[lo:hi] = marks.kernel(names[lo:hi])
    mean = _means(values, blocks, owned, times, length) @ white
    size = np.sqrt((mean**2).sum(1).mean()) or 1.0
    both = np.where(y > 0, share or (y > 0).mean(), 1 - (share or (y > 0).mean())) / np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    second = _svm(mean / size, y, 100.0 * both * len(y))
    # To begin with, words are as high as the landmark that they come nearest to.
    score = np.concatenate([(values[lo:hi] / np.diag(marks.gram).astype(np.float32)).max(1) for lo, hi in blocks])
    working: set[int] = set()
    model = Model(marks, np.zeros((len(marks.units), 2), np.float32), 0.0, ((1.0, 0.0),) * 2)
    for _ in range(ROUNDS):
        tops = Counter(int(o[np.argmax(score[o])]) for o in silent) + Counter(told)
        wrong = np.flatnonzero((in_clean > 0) & (score > -1))
        working.update(wrong[np.lexsort((wrong, -score[wrong]))][:WORKING].tolist())
        positive, negative = sorted(tops), sorted(working)
        heavy, light = np.array([tops[i] for i in positive], float), in_clean[negative].astype(float)
        more = [f for i in positive for f in filled(names[i])]
        x = marks.kernel([*(names[i] for i in positive), *more, *(names[i] for i in negative)]).astype(np.float64) @ white
        x = np.vstack([x, np.zeros((1, x.shape[1]))])  # a word that shares nothing
        cost = np.concatenate([heavy, np.repeat(heavy, 2) / 4, 4 * light, [len(y)]])
        w = _svm(x, np.concatenate([np.ones(3 * len(positive)), -np.ones(len(negative) + 1)]), cost)
        model.weights, model.bias = np.stack([white @ w[:-1], white @ second[:-1] / size], 1).astype(np.float32), float(w[-1])
        found = np.concatenate([values[lo:hi].astype(np.float32) @ model.weights for lo, hi in blocks]) + np.array([model.bias, 0], np.float32)
        score = found[:, 0]
    highest = np.array([max(model.bias, score[o].max(initial=model.bias)) for o in owned])
    means = np.array([(found[o, 1] * t).sum() / (n + PRIOR) for o, t, n in zip(owned, times, length, strict=True)])
    share = float((y > 0).mean()) if share is None else share
    model.logistic = (_platt(highest, y, share), _platt(means, y, share))
    return model


def _means(values: np.ndarray, blocks: list[tuple[int, int]], owned: list[np.ndarray], times: list[np.ndarray], length: list[int]) -> np.ndarray:
    """The mean kernel values of each document's words, some words at a time."""
    doc = np.repeat(np.arange(len(owned), dtype=np.int32), [len(o) for o in owned])
    word, n = np.concatenate([np.zeros(0, np.int32), *owned]), np.concatenate([np.zeros(0, np.int32), *times])
    order = np.argsort(word, kind="stable")
    doc, word, n = doc[order], word[order], n[order]
    out = np.zeros((len(owned), values.shape[1]))
    for lo, hi in blocks:
        a, b = np.searchsorted(word, [lo, hi])
        for i in range(a, b, 65_536):
            j = min(i + 65_536, b)
            by = np.argsort(doc[i:j], kind="stable")
            d = doc[i:j][by]
            first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            out[d[first]] += np.add.reduceat(values[word[i:j][by]].astype(np.float32) * n[i:j][by][:, None], first, axis=0)
    return out / (np.array(length)[:, None] + PRIOR)


def training_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_DOCS) -> DataFrame | None:
    """_key, _text, _label of at most `most` labelled texts of each label, those of smallest hash of the key, up to MOST_BYTES of each label; null if there are none.

    A document with several labels is toxic if one says so; null labels and keys are none. Of rows with one key the shortest text stands for all. Only keys of the sample, and their
    sizes, come to the driver.
    """
    one = labels.filter(col(label).isNotNull() & col(key).isNotNull()).groupBy(col(key).alias("_key")).agg(F.max(col(label)).alias("_label"))
    ids = []
    for value in (0, 1):
        ids += [(r[0], value) for r in one.filter((F.col("_label") > 0) == bool(value)).orderBy(F.xxhash64("_key"), "_key").limit(most).collect()]
    if not ids:
        return None
    sample = docs.sparkSession.createDataFrame(ids, T.StructType([T.StructField("_key", labels.schema[key].dataType), T.StructField("_label", T.IntegerType())]))
    found = docs.select(col(key).alias("_key"), F.coalesce(col(text), F.lit("")).alias("_text")).join(F.broadcast(sample), "_key")
    which = F.struct(F.octet_length("_text").alias("n"), F.xxhash64("_text").alias("x"))
    sizes = found.groupBy("_key", "_label").agg(F.min(which).alias("one")).orderBy(F.xxhash64("_key"), "_key").collect()
    chosen, used = [], {0: 0, 1: 0}
    for r in sizes:
        if used[r._label] + r.one.n <= MOST_BYTES:
            used[r._label] += r.one.n
            chosen.append((r._key, r.one.n, r.one.x))
    if not chosen:
        return None
    wanted = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("_key", labels.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("x", T.LongType())]))
    same = (F.octet_length("_text") == F.col("n")) & (F.xxhash64("_text") == F.col("x"))
    return found.join(F.broadcast(wanted), "_key").filter(same).groupBy(F.col("_key").cast("string").alias("_key"), "_label").agg(F.min("_text").alias("_text")).select("_key", "_text", "_label")


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_DOCS) -> list[tuple[str, int]]:
    """Texts and labels of the sample, in order of their keys."""
    sample = training_sample(docs, labels, key, text, label, most)
    return [] if sample is None else [(t, y) for _, t, y in sorted(tuple(r) for r in sample.collect())]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_DOCS) -> Model:
    """A model of the labelled documents. Nothing but the texts goes into it; the caller chooses the labels to learn from.

    One task fits it on the sample, whose size is bounded; the driver gets the model alone. A lost executor costs another fit.
    """
    small_batches(docs.sparkSession)
    sample = training_sample(docs, labels, key, text, label, most)
    if sample is None:
        return fit([], [])
    of = labels.filter(col(label).isNotNull() & col(key).isNotNull()).groupBy(col(key)).agg(F.max(col(label)).alias("_label"))
    share = of.agg(F.avg((F.col("_label") > 0).cast("double"))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([t for _, t, _ in rows], [y for _, _, y in rows], share))], pa.binary())], names=["model"])

    return pickle.loads(sample.repartition(1).mapInArrow(run, "model binary").first().model)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= CUT) to every row.

    Texts are whole; null is empty. An empty text scores as a sentence without words would. Repeated rows give repeated results; an empty table
    gives none. Columns of the input stay, but for those whose names are new ones'.
    """
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # a weight for each subsequence of a landmark: some hundred KB
    keep = kept(df, ["score", "predicted"])
    columns = list(dict.fromkeys([*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            s = scorer.scores(texts(b, text))
            yield with_arrays(b, {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= CUT).astype(np.int32), pa.int32())}, keep)

    fields = [df.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return df.select(*map(col, columns)).mapInArrow(run, T.StructType(fields))

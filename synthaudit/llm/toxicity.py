"""Toxicity: a subsequence string kernel with Nystrom landmarks and a linear
support vector machine, trained on sentences.

Letters.  A-Z are lower-cased; letters and bytes beyond ASCII count, white
space ends a word, every other character is skipped, and words of a single
letter that follow each other are joined.  So ``i.d-i o t`` spells one word.

Kernel.  A word is described by all subsequences of three letters that span
at most six, weighted by ``DECAY`` to the number of skipped letters: inserted
characters weaken a match but do not undo it.  ``k(word, landmark)`` is the
product of the descriptions, normalised by the landmark's, at most one, to
the power ``POWER``.  A sentence takes the largest value over its words for
each landmark.

Landmarks are stretches of four to nine letters (the mark counts), chosen on the
labelled sample by how far their share of toxic documents exceeds that of the
others, none too like a better one, and some frequent ones for contrast.  With the kernel matrix K of the landmarks a
sentence's features are K^(-1/2) k, as by Nystrom.  A document's label belongs
to at least one of its sentences: training alternates between choosing each
toxic document's most toxic sentence and fitting the machine against all
sentences of the other documents.  A document's margin is that of its most
toxic sentence; a logistic curve turns it into the score.

The machine is linear, so scoring needs one weight per landmark; a task
describes each distinct word of a block of texts once.  Nothing is shuffled.
The labelled sample is bounded: ``max_rows`` of each label, by a hash of the
id (documented limit, default 2,500).

Defined cases: a null or empty text scores as one without any word; without
labelled rows of both kinds the score is the smoothed share of label 1 (0.5
without labels); repeated rows are scored each; an empty table gives no row;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthaudit.functions.shipping import ship_package
from synthaudit.llm.common import SPACE_WORD, hash_words, lower_ascii, mix64, schema_of, text_blocks
from synthaudit.llm.quality import labelled_sample

DECAY, POWER = 0.7, 3
GAPS = [(a, b) for a in range(1, 5) for b in range(1, 5) if a + b <= 5]
CODES = 32 ** 3
FAINT = 0.3                # kernel values (before the power) below this count as zero

MARK = 31
#: letter codes: 1-26 for a-z, 27-30 for bytes beyond ASCII, 0 for all else
_CODE = np.array([b - 96 if 97 <= b <= 122 else 27 + b % 4 if b >= 128 else 0 for b in range(256)], np.int64)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def spell(data: np.ndarray, offsets: np.ndarray):
    """Letters of a block of texts: ``codes``; ``bounds`` of its words among
    them; the sentence of each word; the number of sentences up to each text."""
    low = lower_ascii(data)
    n = len(low)
    space = np.append(~SPACE_WORD[low], True)              # the end counts as white space
    ends = np.zeros(n + 1, bool)
    ends[offsets] = True
    close = (_STOP[low] & (space[1:] | ends[1:])) | (low == 10)
    start = np.zeros(n, bool)                              # a sentence begins here
    if n:
        start[1:] = close[:-1]
        start[offsets[:-1][np.diff(offsets) > 0]] = True
    sentence = np.cumsum(start) - 1
    code = _CODE[low]
    letter = np.flatnonzero(code)
    if not len(letter):
        none = np.zeros(0, np.int64)
        return none, np.zeros(1, np.int64), none, np.concatenate([[0], np.cumsum(start)])[offsets]
    gap = np.cumsum(space[:-1])
    new = np.ones(len(letter), bool)
    new[1:] = (gap[letter[1:]] != gap[letter[:-1]]) | (sentence[letter[1:]] != sentence[letter[:-1]])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(letter)))
    where = sentence[letter[first]]
    joined = np.zeros(len(first), bool)
    joined[1:] = (size[1:] == 1) & (size[:-1] == 1) & (where[1:] == where[:-1])
    first = first[~joined]
    codes = np.insert(code[letter], first, MARK)
    bounds = np.append(first + np.arange(len(first)), len(codes))
    return codes, bounds, where[~joined], np.concatenate([[0], np.cumsum(start)])[offsets]


def describe(codes: np.ndarray, bounds: np.ndarray):
    """(word, subsequence, weight) of all words, gaps included."""
    word = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    words, subs, weights = [], [], []
    for a, b in GAPS:
        n = len(codes) - a - b
        if n <= 0:
            continue
        own = np.flatnonzero(word[:n] == word[a + b:])
        words.append(word[own])
        subs.append((codes[own] * 32 + codes[own + a]) * 32 + codes[own + a + b])
        weights.append(np.full(len(own), DECAY ** (a + b - 2)))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(words), np.concatenate(subs), np.concatenate(weights)


class Kernel:
    """Kernel values of words with a list of landmarks (arrays of letter codes)."""

    def __init__(self, landmarks: list[np.ndarray]):
        self.m = m = len(landmarks)
        bounds = np.cumsum([0] + [len(x) for x in landmarks])
        word, sub, weight = describe(np.concatenate(landmarks), bounds)
        table = np.zeros((m, CODES), np.float32)
        np.add.at(table, (word, sub), weight)
        norm = (table ** 2).sum(axis=1)
        both = table @ table.T / np.sqrt(np.outer(norm, norm))
        self.gram = np.clip(both, 0, 1) ** POWER
        mark, sub = np.nonzero(table)
        order = np.argsort(sub, kind="stable")
        self.mark, self.weight = mark[order], (table[mark, sub] / norm[mark])[order]
        self.first = np.searchsorted(sub[order], np.arange(CODES + 1))

    def values(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words with any notable value, and their values."""
        word, sub, weight = describe(codes, bounds)
        count = self.first[sub + 1] - self.first[sub]
        on = np.flatnonzero(count)
        word, sub, weight, count = word[on], sub[on], weight[on], count[on]
        entry = np.repeat(np.arange(len(on)), count)
        at = self.first[sub][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
        touched, place = np.unique(word, return_inverse=True)
        value = np.bincount(place[entry] * self.m + self.mark[at], weight[entry] * self.weight[at],
                            len(touched) * self.m).reshape(-1, self.m)
        value = np.minimum(value, 1.0).astype(np.float32)
        value[value < FAINT] = 0
        keep = value.any(axis=1)
        return touched[keep], value[keep] ** POWER


def sentence_values(kernel: Kernel, data: np.ndarray, offsets: np.ndarray):
    """(sentences with a notable word, their kernel values, bounds of the
    texts among all sentences)."""
    codes, bounds, where, text_bounds = spell(data, offsets)
    if len(bounds) < 2:
        return np.zeros(0, np.int64), np.zeros((0, kernel.m)), text_bounds
    keys = hash_words((codes + 32).astype(np.uint8), bounds[:-1], bounds[1:])
    _, one, same = np.unique(keys, return_index=True, return_inverse=True)
    size = np.diff(bounds)[one]
    own = np.repeat(bounds[one], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    active, value = kernel.values(codes[own], np.concatenate([[0], np.cumsum(size)]))
    slot = np.full(len(one), -1)
    slot[active] = np.arange(len(active))
    use = np.flatnonzero(slot[same] >= 0)
    if not len(use):
        return np.zeros(0, np.int64), np.zeros((0, kernel.m)), text_bounds
    sentences, first = np.unique(where[use], return_index=True)
    return sentences, np.maximum.reduceat(value[slot[same[use]]], first, axis=0), text_bounds


# ------------------------------------------------------------------ training
WIDTHS = range(4, 10)
_BUCKETS = 23              # bits of the table that counts stretches
BLOCK = 1 << 19            # bytes of text described at once


def _stretches(data: np.ndarray, offsets: np.ndarray, width: int):
    """The distinct (text, stretch of ``width`` letters inside a word)."""
    codes, bounds, where, text_bounds = spell(data, offsets)
    word = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    text = (np.searchsorted(text_bounds, where, "right") - 1)[word]
    n = max(0, len(codes) - width + 1)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = key * 32 + codes[k:k + n]
    own = word[:n] == word[width - 1:width - 1 + n]
    pair = np.unique(text[:n][own] << 45 | key[own])
    return pair >> 45, pair & ((1 << 45) - 1)


def _bucket(key: np.ndarray) -> np.ndarray:
    return (mix64(key) >> np.uint64(64 - _BUCKETS)).astype(np.int64)


def _spelled(width: int, key: int) -> np.ndarray:
    return np.array([key >> (5 * k) & 31 for k in reversed(range(width))])


def choose_landmarks(texts: pa.Array, y: np.ndarray, toxic: int, plain: int, least: int = 3,
                     alike: float = 0.6) -> list[np.ndarray]:
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    def gain(in1, in0):
        p1, p0 = (in1 + 0.5) / (n1 + 1), (in0 + 0.5) / (n0 + 1)
        return p1 * np.log(p1 / p0)

    counts: dict[tuple[int, int], list[int]] = {}
    for width in WIDTHS:                                   # one table at a time: the driver's memory is small
        seen = np.zeros((2, 1 << _BUCKETS), np.uint16)     # the sample has fewer than 2^16 rows
        for i, j, data, off in text_blocks(texts):
            text, key = _stretches(data, off, width)
            at = _bucket(key)
            for label in (0, 1):
                np.add.at(seen[label], at[y[i:j][text] == label], 1)
        at = np.flatnonzero(seen[1] >= least)
        best = at[np.argsort(-gain(seen[1][at].astype(float), seen[0][at].astype(float)), kind="stable")[:8 * toxic]]
        often = np.flatnonzero(seen[0] >= max(1, int(np.partition(seen[0], -plain)[-plain])))[:2 * plain]
        wanted = np.unique(np.concatenate([best, often]))
        if not len(wanted):
            continue
        for i, j, data, off in text_blocks(texts):
            text, key = _stretches(data, off, width)
            at = _bucket(key)
            hit = wanted[np.minimum(np.searchsorted(wanted, at), len(wanted) - 1)] == at
            for label in (0, 1):
                for k, n in zip(*np.unique(key[hit & (y[i:j][text] == label)], return_counts=True)):
                    counts.setdefault((width, int(k)), [0, 0])[label] += int(n)
    del seen
    ranked = sorted(((-gain(c[1], c[0]), w, k) for (w, k), c in counts.items() if c[1] >= least))
    common = sorted(((-c[0], w, k) for (w, k), c in counts.items() if c[0]))
    chosen: list[np.ndarray] = []
    table = np.zeros((toxic + plain, CODES), np.float32)   # the normalised descriptions of the chosen
    for pool, most in ((ranked, toxic), (common, toxic + plain)):
        for score, width, key in pool:
            if len(chosen) >= most or score >= 0:
                break
            new = _spelled(width, key)
            _, sub, weight = describe(new, np.array([0, width]))
            row = np.bincount(sub, weight, CODES)
            row /= np.linalg.norm(row)
            at = np.flatnonzero(row)
            if not chosen or (table[:len(chosen), at] @ row[at]).max() < alike:
                table[len(chosen)] = row
                chosen.append(new)
    return chosen


def _machine(blocks: list, signs: list, weights: list, root: np.ndarray, c: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, intercept last, of the squared-hinge support vector machine on
    the features ``k @ root``; rows of sign 0 take no part."""
    m = len(root)
    wide = np.eye(m + 1)
    wide[:m, :m] = root
    w = np.zeros(m + 1)
    ridge = np.full(m + 1, 1.0)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        gram, right = np.zeros((m + 1, m + 1)), np.zeros(m + 1)
        for k, s, weight in zip(blocks, signs, weights):
            x = np.ones((len(k), m + 1), np.float32)
            x[:, :m] = k
            on = (s != 0) & (s * (x @ (wide @ w)) < 1)
            x, cs = x[on].astype(np.float64), c * weight[on]
            gram += x.T @ (x * cs[:, None])
            right += x.T @ (cs * s[on])
        new = np.linalg.solve(np.diag(ridge) + wide.T @ gram @ wide, wide.T @ right)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([(weight * (p - y) * margin).sum() + 1e-3 * a, (weight * (p - y)).sum()])
        h = weight * p * (1 - p)
        hess = np.array([[(h * margin ** 2).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


@dataclass
class Model:
    landmarks: list[np.ndarray]
    weight: np.ndarray         # per landmark
    intercept: float
    slope: float
    shift: float


def train(texts: pa.Array, y: np.ndarray, row_weight: np.ndarray, toxic: int = 128, plain: int = 16) -> Model:
    share = (float((row_weight * y).sum()) + 1) / (float(row_weight.sum()) + 2)
    constant = Model([], np.zeros(0), 0.0, 1.0, float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return constant
    landmarks = choose_landmarks(texts, y, toxic, plain)
    if not landmarks:
        return constant
    kernel = Kernel(landmarks)
    value, vector = np.linalg.eigh(kernel.gram)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    owners, blocks = [], []            # half precision: values between 0 and 1, for training only
    for i, _, data, off in text_blocks(texts, BLOCK):
        sentences, values, bounds = sentence_values(kernel, data, off)
        owners.append(np.searchsorted(bounds, sentences, "right") - 1 + i)
        blocks.append(values.astype(np.float16))
    owner, cuts = np.concatenate(owners), np.cumsum([len(k) for k in blocks])[:-1]
    clean = y[owner] == 0
    rank = np.concatenate([k[:, :toxic].max(axis=1) for k in blocks]).astype(float)
    silent = np.zeros((1, kernel.m), np.float16)           # a sentence without any notable word
    for _ in range(4):
        order = np.lexsort((-rank, owner))
        first = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])] if len(order) else order
        picked = first[~clean[first]]
        sign = np.where(clean, -1.0, 0.0)
        sign[picked] = 1.0
        w = _machine(blocks + [silent], np.split(sign, cuts) + [np.array([-1.0])],
                     np.split(np.where(sign > 0, 4.0, 1.0), cuts) + [np.array([max(1.0, len(picked))])], root)
        rank = np.concatenate([k.astype(np.float32) @ (root @ w[:-1]) for k in blocks])
    margin = np.full(len(y), w[-1])
    np.maximum.at(margin, owner, rank + w[-1])
    slope, shift = _logistic(margin, y, row_weight)
    return Model(landmarks, root @ w[:-1], float(w[-1]), slope, shift)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 2_500) -> Model:
    """Train on the documents that ``labels`` (``doc_id, label`` 0 or 1) names."""
    ship_package(docs.sparkSession)
    labels = labels.where(F.col("label").isin(0, 1))
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    rows = labelled_sample(docs, labels, max_rows).select("text", F.col("label").cast("int").alias("label")).toArrow()
    rows = rows.sort_by([("label", "ascending"), ("text", "ascending")])
    y = rows.column("label").to_numpy().astype(np.int64)
    scale = np.array([counts.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)])
    texts = rows.column("text").combine_chunks()
    return train(texts, y, scale[y] if len(y) else np.zeros(0))


def margins(model: Model, kernel: Kernel | None, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.full(len(offsets) - 1, model.intercept)
    if kernel is not None:
        sentences, values, bounds = sentence_values(kernel, data, offsets)
        np.maximum.at(out, np.searchsorted(bounds, sentences, "right") - 1, values @ model.weight + model.intercept)
    return out


def _score_rows(shared):
    def run(batches):
        model = shared.value
        kernel = Kernel(model.landmarks) if model.landmarks else None
        for batch in batches:
            for i, j, data, off in text_blocks(batch.column("text"), BLOCK):
                m = margins(model, kernel, data, off)
                score = 1 / (1 + np.exp(-np.clip(model.slope * m + model.shift, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(score)],
                                                 names=["doc_id", "score"])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` for each row."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _score_rows(spark.sparkContext.broadcast(model)),
        schema_of(("doc_id", docs.schema["doc_id"].dataType), ("score", "double")))
    return rows.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

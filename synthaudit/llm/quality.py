"""Quality classifier: histogram gradient-boosted trees over document
statistics.

``fit`` takes a bounded sample of the labelled rows (``max_rows`` of each
label, chosen by a hash of the id; documented limit, default 20,000), bins
every statistic into at most 255 bins and boosts depth-limited trees on
histograms of gradients.  The trees are flattened into arrays (statistic,
threshold, children, value), and a task walks all its rows through a tree at
once with numpy index arithmetic.  Scoring reads each whole text once and
moves no rows.

Defined cases: a null or empty text has the statistics of an empty text; with
no labelled row, or labels of one kind, the score is the smoothed share of
label 1 (0.5 without labels); a label row whose id is null or repeated counts
for each match; repeated documents are scored row by row; an empty table gives
no rows; other columns are ignored by ``score`` and carried by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthaudit.functions.shipping import ship_package
from synthaudit.llm.common import schema_of, text_blocks, whole_rows
from synthaudit.llm.docstats import FEATURES, statistics


@dataclass
class Trees:
    """Flattened trees: node ``i`` sends a row to ``left[i]`` if its statistic
    ``feature[i]`` is at most ``threshold[i]``, else to ``left[i] + 1``; a
    leaf points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    leaf: np.ndarray
    value: np.ndarray
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                right = x[row, self.feature[at]] > self.threshold[at]
                at = np.where(self.leaf[at], at, self.left[at] + right)
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw(x)))


def _bins(x: np.ndarray, most: int) -> list[np.ndarray]:
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        middle = (values[:-1] + values[1:]) / 2
        if len(middle) > most - 1:
            middle = np.unique(np.quantile(x[:, f], np.linspace(0, 1, most + 1)[1:-1]))
        cuts.append(middle)
    return cuts


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, max_bins: int = 255,
          min_rows: int = 10, l2: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss on binned statistics."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    nodes: list[list] = []      # feature, threshold, left, leaf, value
    roots = []
    two_kinds = 0 < y.sum() < len(y)
    if two_kinds:
        cuts = _bins(x, max_bins)
        width = max(len(c) for c in cuts) + 1
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
        n_features = x.shape[1]
        flat = binned + np.arange(n_features) * width
    raw = np.full(len(y), base)
    for _ in range(rounds if two_kinds else 0):
        p = 1.0 / (1.0 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, 0.0, 0, True, 0.0])
        work = [(roots[-1], np.arange(len(y)), 0)]
        while work:
            at, rows, level = work.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            nodes[at][4] = -rate * g / (h + l2)
            best = None
            if level < depth and len(rows) >= 2 * min_rows:
                cell = flat[rows].ravel()
                shape = (n_features, width)
                size = n_features * width
                gs = np.bincount(cell, np.repeat(grad[rows], n_features), size).reshape(shape).cumsum(axis=1)
                hs = np.bincount(cell, np.repeat(hess[rows], n_features), size).reshape(shape).cumsum(axis=1)
                ns = np.bincount(cell, minlength=size).reshape(shape).cumsum(axis=1)
                gain = gs ** 2 / (hs + l2) + (g - gs) ** 2 / (h - hs + l2) - g ** 2 / (h + l2)
                gain[(ns < min_rows) | (len(rows) - ns < min_rows)] = -np.inf
                f, b = np.unravel_index(np.argmax(gain), shape)
                if gain[f, b] > 1e-6 and b < len(cuts[f]):
                    best = f, b
            if best is None:
                raw[rows] += nodes[at][4]
                continue
            f, b = best
            goes_left = binned[rows, f] <= b
            nodes[at][:4] = [int(f), float(cuts[f][b]), len(nodes), False]
            for part in (rows[goes_left], rows[~goes_left]):
                work.append((len(nodes), part, level + 1))
                nodes.append([0, 0.0, 0, True, 0.0])
    columns = list(zip(*nodes)) if nodes else [[], [], [], [], []]
    return Trees(base, np.array(roots, np.int64), np.array(columns[0], np.int64), np.array(columns[1], float),
                 np.array(columns[2], np.int64), np.array(columns[3], bool), np.array(columns[4], float), depth)


def _statistic_rows(batches):
    for batch in batches:
        for i, j, data, off in text_blocks(batch.column("text")):
            x = statistics(data, off)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").slice(i, j - i),
                 pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))],
                names=["label", "x"])


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """``doc_id, text, label`` of at most about ``max_rows`` rows of each
    label: a label's share is fixed from its count, rows go by a hash of the id."""
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    share = F.lit(1.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, max_rows / n))).otherwise(share)
    chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000)
    own = docs.select(F.col("doc_id").alias("own_id"), F.col("text").cast("string").alias("text"))
    # the chosen ids are at most 2 * max_rows rows: a proven size
    return own.join(F.broadcast(chosen.select("doc_id", "label")), F.col("own_id") == F.col("doc_id")).select(
        "doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **settings) -> Trees:
    """Train on the documents that ``labels`` (``doc_id, label`` 0 or 1) names."""
    ship_package(docs.sparkSession)
    labels = labels.where(F.col("label").isin(0, 1))
    sample = labelled_sample(docs, labels, max_rows).select("text", F.col("label").cast("int").alias("label"))
    rows = sample.mapInArrow(_statistic_rows, schema_of(("label", "int"), ("x", "array<double>"))).toArrow()
    y = rows.column("label").to_numpy().astype(float)
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))              # the same trees in whatever order the rows arrive
    return boost(x[order], y[order], **settings)


def _score_rows(shared):
    def run(batches):
        trees = shared.value
        for batch in batches:
            for i, j, data, off in text_blocks(batch.column("text")):
                p = trees.probability(statistics(data, off))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(p)],
                                                 names=["doc_id", "score"])
    return run


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """``doc_id, score, predicted`` for each row."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _score_rows(spark.sparkContext.broadcast(trees)),
        schema_of(("doc_id", docs.schema["doc_id"].dataType), ("score", "double")))
    return rows.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, trees: Trees) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model accepts."""
    return score(whole_rows(docs), trees).where(F.col("predicted") == 1).select("doc_id.*")

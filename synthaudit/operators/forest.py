"""Random forests whose trees grow fully, on sparse one-hot features (M2).

Rows have ``numbers`` (numeric features) and ``levels`` (one dummy per text
column, 0 for none; see ``encode``), so a table of 100,000 dummies costs no
more per row than one of ten.  A tree grows on a bootstrap sample (Poisson
weights by a hash of row and tree), looks at ``sqrt(features)`` drawn features
a node, and at another one where none of these splits it; a node is a leaf
when it is pure, when no feature tells its rows apart, or at ``depth``.

Every split is chosen on all rows of its node, from sums of whole weights, so
a tree does not depend on how rows are grouped, dealt or batched:

1. where no forest has more than ``group_rows`` rows to learn from or to
   predict, and the trees will not be small, its rows go whole to a few tasks,
   each of which grows some of its trees and adds up their votes; neither trees
   nor rows by tree are sent;
2. otherwise the rows that a tree draws are dealt to it in packed blocks, equal
   rows of a block as one with their weights added, and every (tree, node) of
   at most ``group_rows`` of these is grown to the end inside a task and written
   as one row.  Larger nodes are split first, by one level a round until none
   is left: each numeric column has a copy of the rows dealt by ranges of its
   values; a range counts the classes of the nodes that drew the column, gets
   the counts of the ranges before it, and scores the cuts between its values.
   Dummies are scored on their class counts.  No row is multiplied by the trees
   for it.  A large node that is pure, that no feature splits or that is at
   ``depth`` becomes a leaf with the class shares of all its rows;
3. rows to predict are routed through the split nodes, meet the subtree of
   their (tree, node) in groups of at most ``group_rows`` rows, and vote with
   the class shares of their leaf; votes are added up by row.  Trees of at most
   ``SMALL_FOREST`` bytes together are shipped to the rows instead, which then
   stay where they are and send all their votes as one row.

Only the split large nodes and forests of at most ``SMALL_FOREST`` bytes reach
the driver.  Rows are dealt anew before they are multiplied by the trees, and
group sizes are counted without their rows.  Trees are taken in batches, so that
the rows of a batch stay near ``ROWS_AT_ONCE``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from synthaudit.functions.shipping import ship_package
from synthaudit.session import cut_lineage

GROUP_ROWS = 500_000
ROWS_AT_ONCE = 200_000_000
DEALT_ROWS = 200_000           # rows that a task deals out at once
DEALT_AT_ONCE = 1_000_000      # rows times trees in one batch of blocks
VOTES_AT_ONCE = 100_000        # votes of a batch sent back by a task
SMALL_FOREST = 32_000_000      # bytes of all trees of a batch that are shipped to the rows to predict
NODE_BYTES = 60                # of a grown tree for each row unlike the others, about
WHOLE_VOTES = 8_000_000        # rows times classes whose votes are added up in one array
ROUTED_AT_ONCE = 16_384        # rows that go down a tree together
FEW = 64                       # dummies of a tree that are laid out as columns for it


# ------------------------------------------------------------------ growing
@dataclass
class Tree:
    """Nodes in order of discovery; ``feature`` -1 marks a leaf.  Leaf shares
    are (node, class, weight share) triples."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray
    label: np.ndarray
    share: np.ndarray

    FIELDS = (("feature", np.int32), ("threshold", np.float64), ("left", np.int32), ("right", np.int32),
              ("leaf", np.int32), ("label", np.int32), ("share", np.float64))

    def pack(self) -> dict[str, bytes]:
        return {name: np.ascontiguousarray(getattr(self, name), kind).tobytes() for name, kind in self.FIELDS}

    @classmethod
    def unpack(cls, row: dict) -> Tree:
        return cls(*[np.frombuffer(row[name], kind) for name, kind in cls.FIELDS])

    def leaves(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, leaf, width = np.zeros(len(x), np.int64), self.feature < 0, x.shape[1]
        if leaf[0]:
            return out
        threshold = np.where(leaf, np.inf, self.threshold)          # a leaf keeps its rows
        to = np.stack([np.where(leaf, np.arange(len(leaf)), self.left), self.right], axis=1).astype(np.int64).reshape(-1)
        dummies = np.unique(self.feature[self.feature >= width])
        few = len(dummies) <= FEW
        if few:
            place = np.where(self.feature < width, self.feature, width + np.searchsorted(dummies, self.feature))
            place = np.where(leaf, 0, place).astype(np.int64)
        for first in range(0, len(x), ROUTED_AT_ONCE):
            xs, gs = x[first:first + ROUTED_AT_ONCE], g[first:first + ROUTED_AT_ONCE]
            todo, at = np.arange(len(xs)), np.zeros(len(xs), np.int64)
            if few:
                values = np.concatenate([xs, *[(gs == d - width + 1).any(axis=1)[:, None] for d in dummies]], axis=1)
                row, values = todo * values.shape[1], values.reshape(-1)
            while len(todo):
                for _ in range(3):
                    if few:
                        right = values[row + place[at]] > threshold[at]
                    else:
                        f = self.feature[at]
                        right = (gs[todo] == (f - width + 1)[:, None]).any(axis=1) & (f >= width)
                        number = np.flatnonzero((f >= 0) & (f < width))
                        right[number] = xs[todo[number], f[number]] > threshold[at[number]]
                    at = to[2 * at + right]
                on = ~leaf[at]
                out[first + todo[~on]] = at[~on]
                todo, at = todo[on], at[on]
                if few:
                    row = row[on]
        return out


_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _uniform(path: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """A draw in [0, 1) for (node, feature), the same wherever the node is grown."""
    h = (path ^ (feature.astype(np.uint64) * _K1)) * _K2
    h ^= h >> np.uint64(29)
    h *= _K1
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    first = np.ones(len(keys[0]), bool)
    first[1:] = False
    for k in keys:
        first[1:] |= k[1:] != k[:-1]
    return first


def _since(total: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A running sum that restarts at each beginning."""
    at = np.flatnonzero(begins)
    base = np.where(at > 0, total[at - 1], 0.0)
    return total - np.repeat(base, np.diff(np.append(at, len(total))))


def _children(path: np.ndarray) -> np.ndarray:
    """The paths of the left and right child of each node, one after the other."""
    out = np.stack([path * _K1 + np.uint64(1), path * _K1 + np.uint64(2)], axis=1).reshape(-1)
    return out ^ (out >> np.uint64(31))


def _limits(path: np.ndarray, p: int) -> np.ndarray:
    """Nodes look at the features whose draws are not above these."""
    draws = max(1, int(np.sqrt(p)))
    if p > 512:
        return np.full(len(path), draws / p)
    out = np.empty(len(path))
    for i in range(0, len(path), 4096):
        u = _uniform(path[i:i + 4096, None], np.arange(p)[None, :])
        out[i:i + 4096] = np.partition(u, draws - 1, axis=1)[:, draws - 1]
    return out


def _middle(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A threshold that keeps ``low`` left and ``high`` right."""
    with np.errstate(invalid="ignore", over="ignore"):
        middle = (low + high) / 2
    return np.where((middle >= low) & (middle < high), middle, low)


def _top(score: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Where the first of the highest scores of each node is; ``q`` is sorted."""
    start = np.flatnonzero(_begins(q))
    top = np.maximum.reduceat(score, start)
    at = np.flatnonzero(score >= np.repeat(top, np.diff(np.append(start, len(q)))))
    return at[_begins(q[at])]


def _sorted(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys of at most ``most``, and the keys in it."""
    bits = len(key).bit_length()
    if most.bit_length() + bits < 63:                      # sorted as one number with their places: faster
        both = np.sort((key << bits) | np.arange(len(key)))
        return both & ((1 << bits) - 1), both >> bits
    order = np.argsort(key)
    return order, key[order]


@dataclass
class Top:
    """The split large nodes of a tree as a tree whose ends are the nodes that
    go on, and the path and level of each node."""
    tree: Tree
    path: np.ndarray
    level: np.ndarray


class _Level:
    """The impure nodes of one level with their rows, node after node: ``q`` is
    the node of a row, ``r`` its number in ``x``, ``rank`` and ``g`` (one array
    a column), as it is for ``y`` and ``w``, ``own`` the weight of the row's
    class in its node.  Where there are few classes, ``packed`` has the weight
    of the row in the ``bits`` of its class, and ``counts`` the weights of the
    classes (one array each) in the nodes; ``own`` is not used then."""

    def __init__(self, q, r, x, rank, distinct, g, y, w, classes, dummies, weight, squares, own, packed, bits, counts):
        self.q, self.r, self.x, self.rank, self.distinct, self.g, self.y, self.w = q, r, x, rank, distinct, g, y, w
        self.classes, self.dummies, self.packed, self.bits, self.counts = classes, dummies, packed, bits, counts
        self.weight, self.squares, self.own = weight, squares, own      # weight and squared class weights of nodes

    def _offer(self, best, q, score, feature, threshold):
        """Keep the better of the best split so far and these (one a node)."""
        better = score > best[0][q] + 1e-12
        for kept, new in zip(best, (score, feature, threshold)):
            kept[q[better]] = new[better] if isinstance(new, np.ndarray) else new

    def splits(self, chosen) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, feature, threshold) of each node's best split among the
        features for which ``chosen(nodes, features)`` holds; score -1: none."""
        n = len(self.weight)
        best = (np.full(n, -1.0), np.full(n, -1, np.int64), np.zeros(n))
        nodes = np.arange(n)
        for f in range(self.x.shape[1]):
            rows = np.flatnonzero(chosen(nodes, np.full(n, f))[self.q])
            if len(rows):
                self._number(best, f, rows)
        for j in range(len(self.g)):
            self._dummies(best, j, chosen)
        return best

    def _number(self, best, f, rows):
        q = self.q[rows]                                   # sorting does not change it
        order, key = _sorted(q * np.int64(self.distinct[f]) + self.rank[f][self.r[rows]], len(self.weight) * self.distinct[f])
        rows = rows[order]
        cut = np.flatnonzero((key[1:] != key[:-1]) & (q[1:] == q[:-1]))
        if not len(cut):
            return
        qc = q[cut]
        begins = _begins(q)
        if self.counts is not None:
            start, base = np.flatnonzero(begins), np.zeros(len(self.weight), np.int64)
            total = np.cumsum(self.packed[rows])
            base[q[start[1:]]] = total[start[1:] - 1]
            total = total[cut] - base[qc]
            wl, sl, sr = np.zeros(len(cut)), np.zeros(len(cut)), np.zeros(len(cut))
            for k in range(self.classes):
                c = ((total >> (k * self.bits)) & ((1 << self.bits) - 1)).astype(np.float64)
                wl += c
                sl += c * c
                c = self.counts[k][qc] - c
                sr += c * c
        else:
            # weight of the row's class to its left, by runs of (node, class)
            y, w = self.y[self.r[rows]], self.w[self.r[rows]]
            both = q * np.int64(self.classes) + y
            by_class = np.argsort(both, kind="stable")
            before = np.empty(len(rows))
            before[by_class] = _since(np.cumsum(w[by_class]), _begins(both[by_class])) - w[by_class]
            wl = _since(np.cumsum(w), begins)[cut]
            sl = _since(np.cumsum(w * (2 * before + w)), begins)[cut]
            sr = self.squares[qc] - 2 * _since(np.cumsum(w * self.own[rows]), begins)[cut] + sl
        score = sl / wl + sr / (self.weight[qc] - wl)
        at = _top(score, qc)
        low, high = self.x[self.r[rows[cut[at]]], f], self.x[self.r[rows[cut[at] + 1]], f]
        self._offer(best, qc[at], score[at], f, _middle(low, high))

    def _dummies(self, best, j, chosen):
        level = self.g[j][self.r]
        rows = np.flatnonzero(level > 0)
        if not len(rows):
            return
        q, d = self.q[rows], level[rows]
        rows = rows[chosen(q, self.x.shape[1] + d - 1)]
        if not len(rows):
            return
        group = self.q[rows] * np.int64(self.dummies + 1) + level[rows]
        y, w = self.y[self.r[rows]], self.w[self.r[rows]]
        key = group * self.classes + y
        cells = len(self.weight) * (self.dummies + 1) * self.classes
        if self.counts is not None and cells <= 8 * len(rows):
            c = np.bincount(key, w, cells)                 # weight of (node, level, class)
            key = np.flatnonzero(c)
            c, group = c[key], key // self.classes
            own = np.stack(self.counts)[key % self.classes, group // (self.dummies + 1)]
        else:
            order, key = _sorted(key, cells)
            start = np.flatnonzero(_begins(key))
            c = np.add.reduceat(w[order], start)
            order = order[start]
            group = group[order]
            own = (self.own[rows[order]] if self.counts is None
                   else np.stack(self.counts)[y[order], group // (self.dummies + 1)])
        start = np.flatnonzero(_begins(group))
        w1, s1, t1 = (np.add.reduceat(v, start) for v in (c, c * c, c * own))
        q, d = group[start] // (self.dummies + 1), group[start] % (self.dummies + 1)
        w0 = self.weight[q] - w1
        ok = w0 > 1e-9
        q, d, w0, w1, s1, t1 = (v[ok] for v in (q, d, w0, w1, s1, t1))
        if not len(q):
            return
        score = s1 / w1 + (self.squares[q] - 2 * t1 + s1) / w0
        at = _top(score, q)
        self._offer(best, q[at], score[at], self.x.shape[1] + d[at] - 1, 0.5)

    def splitting(self, only: np.ndarray, path: np.ndarray) -> np.ndarray:
        """Of the nodes ``only``, the feature with the smallest draw among those
        that tell rows of the node apart; -1 if there is none."""
        found, draw = np.full(len(self.weight), -1, np.int64), np.full(len(self.weight), 2.0)

        def offer(q, feature):
            u = _uniform(path[q], feature)
            order = np.lexsort((u, q))
            order = order[_begins(q[order])]
            q, feature, u = q[order], feature[order], u[order]
            better = u < draw[q]
            found[q[better]], draw[q[better]] = feature[better], u[better]

        rows = np.flatnonzero(only[self.q])
        if not len(rows):
            return found
        q = self.q[rows]
        start = np.flatnonzero(_begins(q))
        for f in range(self.x.shape[1]):
            r = self.rank[f][self.r[rows]]
            several = np.minimum.reduceat(r, start) < np.maximum.reduceat(r, start)
            if several.any():
                offer(q[start][several], np.full(int(several.sum()), f))
        for j in range(len(self.g)):
            level = self.g[j][self.r[rows]]
            here = rows[level > 0]
            if len(here):
                key, first, which = np.unique(self.q[here] * np.int64(self.dummies + 1) + level[level > 0],
                                              return_index=True, return_inverse=True)
                node, level = self.q[here[first]], level[level > 0][first]
                ok = self.weight[node] - np.bincount(which, self.w[self.r[here]]) > 1e-9
                if ok.any():
                    offer(node[ok], self.x.shape[1] + level[ok] - 1)
        return found


def _root(seed: int) -> np.ndarray:
    return np.array([seed & 0xFFFFFFFFFFFFFFFF], np.uint64) * _K1 + _K2


def _tree_seed(seed: int, forest: int, tree: int) -> int:
    return ((seed * 1_000_003 + forest) * 1_000_003 + tree) * 1_000_003


def _ranks(x: np.ndarray) -> list[np.ndarray]:
    """The place of each value among the distinct ones of its column."""
    return [np.unique(x[:, f], return_inverse=True)[1] for f in range(x.shape[1])]


def grow(x: np.ndarray, g: np.ndarray, y: np.ndarray, w: np.ndarray, dummies: int, seed: int, depth: int | None = None,
         path: np.ndarray | None = None, rank: list[np.ndarray] | None = None) -> Tree:
    """A tree on rows of ``x`` (numbers), ``g`` (levels), class ``y`` and
    weight ``w``; ``path`` is that of its root where it is part of a tree,
    ``rank`` an ascending number of each value, by column."""
    n, p = len(y), x.shape[1] + dummies
    rank = _ranks(x) if rank is None else rank
    distinct = [int(v.max(initial=0)) + 1 for v in rank]
    columns = [g[:, j].astype(np.int64) for j in range(g.shape[1])]
    labels, y = np.unique(y, return_inverse=True)
    classes, w = len(labels), w.astype(np.float64)
    feature, threshold, left, right = [[np.full(1, k)] for k in (-1, 0.0, -1, -1)]
    leaf, label, share = [], [], []
    path = _root(seed) if path is None else path           # of the nodes of this level
    first, total, level = 0, 1, 0                 # number of this level's first node, nodes so far
    rows, q = np.arange(n), np.zeros(n, np.int64)          # rows node after node
    bits = int(w.sum()).bit_length()
    few = bits * classes <= 63
    if few:
        packed = w.astype(np.int64) << (y * bits)
        size = np.array([n])
    while len(rows):
        nodes, own = len(path), None
        if few:                                            # one sum over the rows gives the weights of all classes
            of_row = packed[rows]
            end = np.cumsum(size)
            total_weight = np.cumsum(of_row)[end - 1]      # no node is empty
            total_weight[1:] -= total_weight[:-1].copy()
            counts = [((total_weight >> (k * bits)) & ((1 << bits) - 1)).astype(np.float64) for k in range(classes)]
            flat = np.stack(counts, axis=1).reshape(-1)
            at = np.flatnonzero(flat)
            c, cq, cy = flat[at], at // classes, at % classes
        else:
            key = q * np.int64(classes) + y[rows]
            order = np.argsort(key, kind="stable")
            rows, key = rows[order], key[order]
            start = np.flatnonzero(_begins(key))
            c = np.add.reduceat(w[rows], start)
            cq, cy = q[start], y[rows[start]]
            own = np.repeat(c, np.diff(np.append(start, len(rows))))
        weight, squares = np.bincount(cq, c, nodes), np.bincount(cq, c * c, nodes)
        grows = np.bincount(cq, minlength=nodes) > 1
        if depth is not None and level >= depth:
            grows[:] = False
        best_feature, best_threshold = np.full(nodes, -1, np.int64), np.zeros(nodes)
        if grows.any():
            number = np.cumsum(grows) - 1
            keep = grows[q]
            here = _Level(number[q[keep]], rows[keep], x, rank, distinct, columns, y, w, classes, dummies, weight[grows],
                          squares[grows], None if few else own[keep], of_row[keep] if few else None, bits,
                          [v[grows] for v in counts] if few else None)
            ways = path[grows]
            limit = _limits(ways, p)
            if p <= 512 and len(ways) * p <= 1 << 26:
                drawn = _uniform(ways[:, None], np.arange(p)[None, :]) <= limit[:, None]
                _, f, t = here.splits(lambda a, b: drawn[a, b])
            else:
                _, f, t = here.splits(lambda a, b: _uniform(ways[a], b) <= limit[a])
            if (f < 0).any():
                forced = here.splitting(f < 0, ways)
                if (forced >= 0).any():
                    _, f2, t2 = here.splits(lambda a, b: forced[a] == b)
                    f, t = np.where(f < 0, f2, f), np.where(f < 0, t2, t)
            best_feature[grows], best_threshold[grows] = f, t
        splits = best_feature >= 0
        at = np.flatnonzero(splits)
        child = np.full(nodes, -1, np.int64)
        child[at] = total + 2 * np.arange(len(at))
        feature[-1], threshold[-1] = best_feature, best_threshold
        left[-1], right[-1] = child, np.where(splits, child + 1, -1)
        done = ~splits[cq]
        leaf.append(first + cq[done])
        label.append(labels[cy[done]])
        share.append(c[done] / weight[cq[done]])
        # rows go on to the children, the left ones of a node before its right ones
        keep = splits[q]
        rows, q = rows[keep], q[keep]
        f = best_feature[q]
        number = f < x.shape[1]
        go = np.zeros(len(rows), bool)
        go[number] = x[rows[number], f[number]] > best_threshold[q[number]]
        go[~number] = (g[rows[~number]] == (f[~number] - x.shape[1] + 1)[:, None]).any(axis=1)
        q = 2 * (np.cumsum(splits) - 1)[q] + go
        size = np.bincount(q, minlength=2 * len(at))
        begin, moved = np.cumsum(size) - size, np.empty(len(rows), np.int64)
        for side in (False, True):
            own_rows, own_size = np.flatnonzero(go == side), size[int(side)::2]
            moved[np.repeat(begin[int(side)::2] - (np.cumsum(own_size) - own_size), own_size) + np.arange(len(own_rows))] = rows[own_rows]
        rows, q = moved, np.repeat(np.arange(len(size)), size)
        path = _children(path[at])
        first, total, level = total, total + 2 * len(at), level + 1
        if len(at):
            for part, empty in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1)):
                part.append(np.full(2 * len(at), empty))
    return Tree(*[np.concatenate(v) if v else np.zeros(0) for v in (feature, threshold, left, right, leaf, label, share)])


# ------------------------------------------------------------------ tasks
def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), width)


#: cumulative probabilities of a Poisson variable of mean 1
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 13.0)])))


#: the same in steps of 2 ** -53, rounded up
_STEPS = np.ceil(_POISSON * float(1 << 53)).astype(np.uint64)


def _weights(h: np.ndarray, seed: int, forest: int, tree: int) -> np.ndarray:
    """The bootstrap weights of rows: Poisson draws of mean 1 by a hash of row, forest and tree."""
    with np.errstate(over="ignore"):
        state = np.uint64(0)
        for k in (seed, forest, tree):
            state = (state ^ np.uint64(k)) * _K1 + _K2
        state ^= np.uint64(tree & 0xFFFF) * _K1
        out = np.empty(len(h), np.uint8)
        for i in range(0, len(h), ROUTED_AT_ONCE):         # a block at a time stays in the cache
            u = h[i:i + ROUTED_AT_ONCE].view(np.uint64) ^ state
            u *= _K2
            u ^= u >> np.uint64(29)
            u *= _K1
            u >>= np.uint64(11)
            weight = (u >= _STEPS[0]).view(np.uint8) + (u >= _STEPS[1]).view(np.uint8) + (u >= _STEPS[2]).view(np.uint8)
            many = np.flatnonzero(weight == 3)
            weight[many] = np.searchsorted(_STEPS, u[many], "right")
            out[i:i + ROUTED_AT_ONCE] = weight
    return out


def _alike(x: np.ndarray, g: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """An order that puts equal rows together and where each of them begins;
    None where few rows are equal."""
    columns = [*(x + 0.0).T, *g.T, *more]
    with np.errstate(over="ignore"):
        h = np.zeros(len(x), np.uint64)
        for v in columns:
            v = np.ascontiguousarray(v)
            h = (h ^ (v.view(np.uint64) if v.dtype == np.float64 else v.astype(np.uint64))) * _K1
            h ^= h >> np.uint64(29)
            h *= _K2
            h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    begins = _begins(h[order])
    start = np.flatnonzero(begins)
    if len(start) > 0.8 * len(x):
        return None
    first = order[start][np.cumsum(begins) - 1]
    if any((v[first] != v[order]).any() for v in columns):  # rows of one hash that differ
        return None
    return order, start


def _routed(x: np.ndarray, g: np.ndarray, rows: np.ndarray, top: Top | None) -> np.ndarray:
    """The node below the split large ones that each of ``rows`` reaches."""
    return np.zeros(len(rows), np.int64) if top is None else top.tree.leaves(x[rows], g[rows])


def _members(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(forest, rows of the batch that take part in it)."""
    each = batch.column("forests")
    member = each.flatten().to_numpy()
    parent = np.repeat(np.arange(batch.num_rows), each.value_lengths().to_numpy())
    for forest in np.unique(member).tolist():
        yield forest, parent[member == forest]


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        if "alike" in batch.schema.names:                  # blocks are large enough
            yield batch
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _dealt_rows(batch: pa.RecordBatch, a: int, b: int) -> tuple:
    """A batch with ``h, x, g, y`` of its rows, equal training rows put
    together, and the group of equal rows of each (None: all differ)."""
    training = "label" in batch.schema.names
    h = batch.column("h").to_numpy()
    x, g = _matrix(batch.column("numbers"), np.float64, a), _matrix(batch.column("levels"), np.int32, b)
    y = batch.column("label").to_numpy().astype(np.int32) if training else None
    same = _alike(x, g, y) if training else None
    if same is None:
        return batch, h, x, g, y, None
    order, start = same
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
    return batch.take(pa.array(order)), h[order], x[order], g[order], y[order], group


_PACKED = "h binary, x binary, g binary, y binary, alike binary, forests binary, rows binary"


def _packed(batch: pa.RecordBatch, a: int, b: int) -> dict[str, bytes]:
    """Training rows as they are dealt, as one row; ``forests`` and ``rows`` tell who takes part in what."""
    batch, h, x, g, y, group = _dealt_rows(batch, a, b)
    members = list(_members(batch))
    forests = np.concatenate([np.full(len(r), f) for f, r in members] or [np.zeros(0)]).astype(np.int64)
    rows = np.concatenate([r for _, r in members] or [np.zeros(0)]).astype(np.int32)
    group = np.zeros(0, np.int32) if group is None else group.astype(np.int32)
    return dict(zip(("h", "x", "g", "y", "alike", "forests", "rows"), (v.tobytes() for v in (h, x, g, y, group, forests, rows))))


def _unpacked(batches: Iterator[pa.RecordBatch], a: int, b: int) -> Iterator[tuple]:
    """(batch, [(forest, its rows)], h, x, g, y, group) of rows that come packed or as they are."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if "alike" not in batch.schema.names:
            batch, *rest = _dealt_rows(batch, a, b)
            yield batch, list(_members(batch)), *rest
            continue
        for i in range(batch.num_rows):
            h, y, group, forests, rows = (np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in (
                ("h", np.int64), ("y", np.int32), ("alike", np.int32), ("forests", np.int64), ("rows", np.int32)))
            x = np.frombuffer(batch.column("x")[i].as_buffer(), np.float64).reshape(len(h), a)
            g = np.frombuffer(batch.column("g")[i].as_buffer(), np.int32).reshape(len(h), b)
            at = np.append(np.flatnonzero(_begins(forests)), len(forests)) if len(forests) else [0]
            members = [(int(forests[j]), rows[j:k]) for j, k in zip(at[:-1], at[1:])]
            yield batch, members, h, x, g, y, group if len(group) else None


def _deal(batches: Iterator[pa.RecordBatch], trees: range, seed: int, tops, a: int, b: int,
          schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Packed blocks of rows for each (forest, tree, node), or only their
    sizes where ``schema`` has no rows.  Training rows (with a label) are drawn
    with bootstrap weights, equal ones as one."""
    tops = tops.value if tops is not None else {}
    packed = "x" in schema.names
    for batch, members, h, x, g, y, group in _unpacked(_gathered(batches, DEALT_ROWS), a, b):
        training = y is not None
        for forest, mine in members:
            at = np.flatnonzero(_begins(group[mine])) if group is not None else None
            hashes, blocks, held = h[mine], [], 0
            for tree in trees:
                rows = mine
                if training:
                    weight = _weights(hashes, seed, forest, tree)
                    if at is not None:
                        rows, weight = mine[at], np.add.reduceat(weight, at, dtype=np.int64)
                    rows, weight = rows[weight > 0], weight[weight > 0]
                node = _routed(x, g, rows, tops.get((forest, tree)))
                order = np.argsort(node, kind="stable")
                start = np.flatnonzero(_begins(node[order])) if len(order) else np.zeros(0, np.int64)
                for i, j in zip(start, np.append(start[1:], len(order))):
                    own, k = order[i:j], int(node[order[i]])
                    r = rows[own]
                    block = {"forest": forest, "tree": tree, "node": k, "n": len(r)}
                    if training:
                        block |= {"least": int(y[r].min()), "most": int(y[r].max())}
                    if packed:
                        block |= {"x": x[r].tobytes(), "g": g[r].tobytes()}
                        block |= ({"y": y[r].tobytes(), "w": weight[own].astype(np.int32).tobytes()} if training
                                  else {"h": h[r].tobytes(), "ids": r})
                    blocks.append(block)
                    held += len(r) if packed else 1
                if blocks and held >= DEALT_AT_ONCE:
                    yield _blocks(blocks, batch, schema)
                    blocks, held = [], 0
            if blocks:
                yield _blocks(blocks, batch, schema)


def _blocks(blocks: list[dict], batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """Blocks as rows; ``ids`` are those of the rows of ``batch``."""
    columns = []
    for f in schema:
        if f.name == "ids":
            size = np.cumsum([0] + [len(v["ids"]) for v in blocks])
            ids = batch.column("id").take(pa.array(np.concatenate([v["ids"] for v in blocks])))
            columns.append(pa.ListArray.from_arrays(pa.array(size, pa.int32()), ids).cast(f.type))
        else:
            columns.append(pa.array([v[f.name] for v in blocks], f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_buffer() for v in column), kind)


_TREE = "forest long, tree long, node long, widest long, " + ", ".join(f"{name} binary" for name, _ in Tree.FIELDS)


def _tree_row(forest: int, tree: int, node: int, grown: Tree) -> pa.Table:
    widest = int(np.bincount(grown.leaf).max())             # classes in a leaf, at most
    row = {"forest": forest, "tree": tree, "node": node, "widest": widest} | grown.pack()
    return pa.table({k: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for k, v in row.items()})


def _grow_group(key: tuple, table: pa.Table, a: int, b: int, dummies: int, seed: int, depth, tops) -> pa.Table:
    forest, tree, node = (k.as_py() for k in key)
    y, w = _joined(table.column("y"), np.int32), _joined(table.column("w"), np.int32)
    x = _joined(table.column("x"), np.float64).reshape(len(y), a)
    g = _joined(table.column("g"), np.int32).reshape(len(y), b)
    same = _alike(x, g, y)
    if same is not None:
        order, start = same
        w = np.add.reduceat(w[order].astype(np.int64), start)
        x, g, y = x[order[start]], g[order[start]], y[order[start]]
    top = tops.value.get((forest, tree)) if tops is not None else None
    if top is not None and depth is not None:
        depth -= int(top.level[node])
    path = None if top is None else top.path[node:node + 1]
    return _tree_row(forest, tree, node, grow(x, g, y.astype(np.int64), w, dummies, _tree_seed(seed, forest, tree), depth, path))


def _leaf_group(key: tuple, table: pa.Table) -> pa.Table:
    """A one-leaf tree from the class weights of a (tree, node)."""
    w, label = table.column("weight").to_numpy().astype(np.float64), table.column("label").to_numpy()
    order = np.argsort(label)
    return _tree_row(*(k.as_py() for k in key), Tree(*[np.array([v]) for v in (-1, 0.0, -1, -1)],
                                                     np.zeros(len(w), np.int64), label[order], w[order] / w.sum()))


def _class_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            y, w = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int32) for c in ("y", "w"))
            total = np.bincount(y, w)
            at = np.flatnonzero(total)
            key = [pa.array(np.full(len(at), batch.column(c)[i].as_py())) for c in ("forest", "tree", "node")]
            yield pa.RecordBatch.from_arrays([*key, pa.array(at), pa.array(total[at].astype(np.int64))],
                                             names=["forest", "tree", "node", "label", "weight"])


def _entries(tree: Tree, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shares of the leaves ``at``, one after the other, and how many each has."""
    lo, hi = np.searchsorted(tree.leaf, at, "left"), np.searchsorted(tree.leaf, at, "right")
    n = hi - lo
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n), n


def _vote(left: pa.Table, right: pa.Table, a: int, b: int) -> pa.Table:
    """The class shares of the leaf of each row; one row each for leaves of one class."""
    ids = left.column("ids").combine_chunks().flatten()
    if not right.num_rows or not left.num_rows:
        return pa.table({"forest": pa.array([], pa.int64()), "id": ids.slice(0, 0), "label": pa.array([], pa.int64()),
                         "share": pa.array([], pa.float64())})
    tree = Tree.unpack({name: right.column(name)[0].as_py() for name, _ in Tree.FIELDS})
    at = tree.leaves(_joined(left.column("x"), np.float64).reshape(len(ids), a),
                     _joined(left.column("g"), np.int32).reshape(len(ids), b))
    entry, n = _entries(tree, at)
    row = np.repeat(np.arange(len(at)), n)
    votes = pa.table({"forest": pa.array(np.full(len(row), right.column("forest")[0].as_py())), "id": ids.take(pa.array(row)),
                      "label": pa.array(tree.label[entry].astype(np.int64)), "share": pa.array(tree.share[entry])})
    return pa.Table.from_batches(votes.to_batches(max_chunksize=VOTES_AT_ONCE), votes.schema)


def _grafted(forest: int, tree: int, top: Top | None, pieces: dict) -> Tree:
    """A tree put together from its split large nodes and the pieces below them."""
    parts, instead, size = [], {}, 0
    ends: list = [None]
    if top is not None:
        t, ends = top.tree, np.flatnonzero(top.tree.feature < 0).tolist()
        parts, size = [(t.feature, t.threshold, t.left, t.right, t.leaf, t.label, t.share)], len(t.feature)
    for end in ends:
        part = pieces.get((forest, tree, end or 0))
        if part is None:                                   # no row came here: a leaf without votes
            continue
        if end is not None:
            instead[end] = size
        parts.append((part.feature, part.threshold, np.where(part.left < 0, -1, part.left + size),
                      np.where(part.right < 0, -1, part.right + size), part.leaf + size, part.label, part.share))
        size += len(part.feature)
    if not parts:
        parts = [tuple(np.array(v, k) for v, (_, k) in zip(([-1], [0.0], [-1], [-1], [], [], []), Tree.FIELDS))]
    feature, threshold, left, right, leaf, label, share = (np.concatenate(v) for v in zip(*parts))
    to = np.arange(len(feature))
    to[list(instead)] = list(instead.values())
    left, right = (np.where(v < 0, -1, to[v]) for v in (left, right))
    return Tree(feature, threshold, left, right, leaf, label, share)


def _added(votes: tuple, classes: int) -> tuple:
    """Shares added up by (row, class)."""
    key, which = np.unique(np.concatenate([r * np.int64(classes) + y for r, y, _ in votes]), return_inverse=True)
    return key // classes, key % classes, np.bincount(which, np.concatenate([v for _, _, v in votes]), len(key))


class _Votes:
    """Votes of trees for rows, added up as they come."""

    def __init__(self, rows: int, classes: int):
        self.classes, self.parts, self.held = classes, [], 0
        self.dense = np.zeros(rows * classes) if rows * classes <= WHOLE_VOTES else None

    def add(self, tree: Tree, at: np.ndarray) -> None:
        entry, n = _entries(tree, at)
        row, label, share = np.repeat(np.arange(len(at)), n), tree.label[entry].astype(np.int64), tree.share[entry]
        if self.dense is not None:
            self.dense[row * self.classes + label] += share       # a tree has one share of a (row, class)
            return
        self.parts.append((row, label, share))
        self.held += len(row)
        if self.held > WHOLE_VOTES:
            self.parts = [_added(self.parts, self.classes)]
            self.held = len(self.parts[0][0]) // 2

    def total(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, class, share) of all votes, row by row."""
        if self.dense is None:
            return _added(self.parts or [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)], self.classes)
        key = np.flatnonzero(self.dense)
        return key // self.classes, key % self.classes, self.dense[key]


def _vote_in_place(batches: Iterator[pa.RecordBatch], trees: range, tops, pieces, a: int, b: int,
                   schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Class shares of each row summed over the trees, which come whole; rows that are equal go down them as one."""
    tops = tops.value if tops is not None else {}
    pieces, whole = {k: Tree.unpack(v) for k, v in pieces.value.items()}, {}
    classes = 1 + max((int(t.label.max()) for t in (*pieces.values(),) if len(t.label)), default=0)
    for some in _gathered(batches, VOTES_AT_ONCE):
        x, g = _matrix(some.column("numbers"), np.float64, a), _matrix(some.column("levels"), np.int32, b)
        for forest, rows in _members(some):
            same, own, which = _alike(x[rows], g[rows]), rows, np.arange(len(rows))
            if same is not None:
                order, start = same
                own = rows[order[start]]
                which = np.empty(len(rows), np.int64)
                which[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
            votes = _Votes(len(own), classes)
            for tree in trees:
                if (forest, tree) not in whole:
                    whole[forest, tree] = _grafted(forest, tree, tops.get((forest, tree)), pieces)
                votes.add(whole[forest, tree], whole[forest, tree].leaves(x[own], g[own]))
            row, label, share = votes.total()
            n = np.bincount(row, minlength=len(own))
            begin, n = (np.cumsum(n) - n)[which], n[which]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin, n)
            size = pa.array(np.append(0, np.cumsum(n)), pa.int32())
            columns = (pa.array(np.full(len(rows), forest)), some.column("id").take(pa.array(rows)),
                       pa.ListArray.from_arrays(size, pa.array(label[entry])), pa.ListArray.from_arrays(size, pa.array(share[entry])))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


# ------------------------------------------------------------------ whole forests in a task
def _pack(batches: Iterator[pa.RecordBatch], a: int, b: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of each forest in packed blocks, training rows without ids."""
    for batch in _gathered(batches, DEALT_ROWS):
        if not batch.num_rows:
            continue
        training = "label" in batch.schema.names
        h = batch.column("h").to_numpy()
        x, g = _matrix(batch.column("numbers"), np.float64, a), _matrix(batch.column("levels"), np.int32, b)
        y = batch.column("label").to_numpy().astype(np.int32) if training else None
        blocks = []
        for forest, rows in _members(batch):
            own = {"y": y[rows].tobytes(), "ids": rows[:0]} if training else {"y": None, "ids": rows}
            blocks.append({"forest": forest, "h": h[rows].tobytes(), "x": x[rows].tobytes(), "g": g[rows].tobytes()} | own)
        if blocks:
            yield _blocks(blocks, batch, schema)


def _whole_forest(table: pa.Table, a: int, b: int, dummies: int, seed: int, depth, kind: pa.DataType) -> pa.Table:
    """Votes of the trees ``first`` to ``last`` of a forest, grown and applied here."""
    forest, first, last = (table.column(c)[0].as_py() for c in ("forest", "first", "last"))
    train = table.filter(table.column("y").is_valid())
    test = table.filter(table.column("y").is_null())
    h, y = _joined(train.column("h"), np.int64), _joined(train.column("y"), np.int32).astype(np.int64)
    x = _joined(train.column("x"), np.float64).reshape(len(y), a)
    g = _joined(train.column("g"), np.int32).reshape(len(y), b)
    ids = pa.chunked_array([pa.concat_arrays([c.flatten() for c in test.column("ids").chunks] or [pa.array([], kind)])])
    xt = _joined(test.column("x"), np.float64).reshape(len(ids), a)
    gt = _joined(test.column("g"), np.int32).reshape(len(ids), b)
    starts = None
    if (same := _alike(x, g, y)) is not None:
        order, starts = same
        h, x, g, y = h[order], x[order[starts]], g[order[starts]], y[order[starts]]
    rank = [v.astype(np.int32) for v in _ranks(x)]
    which = np.arange(len(ids))
    if (same := _alike(xt, gt)) is not None:
        order, at = same
        which[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
        xt, gt = xt[order[at]], gt[order[at]]
    votes = _Votes(len(xt), int(y.max(initial=0)) + 1)
    for tree in range(first, last):
        w = _weights(h, seed, forest, tree)
        w = w if starts is None else np.add.reduceat(w, starts, dtype=np.int64)
        r = np.flatnonzero(w)
        if len(r) and len(xt):
            grown = grow(x[r], g[r], y[r], w[r], dummies, _tree_seed(seed, forest, tree), depth, rank=[v[r] for v in rank])
            votes.add(grown, grown.leaves(xt, gt))
    row, label, share = votes.total()
    n = np.bincount(row, minlength=len(xt))
    begin, n = (np.cumsum(n) - n)[which], n[which]
    entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin, n)
    out = pa.table({"forest": pa.array(np.full(len(entry), forest, np.int64)), "id": ids.take(pa.array(np.repeat(np.arange(len(n)), n))),
                    "label": pa.array(label[entry]), "share": pa.array(share[entry])})
    return pa.Table.from_batches(out.to_batches(max_chunksize=VOTES_AT_ONCE), out.schema)


# ------------------------------------------------------------------ large nodes
@dataclass
class Large:
    """The large nodes of a tree that are split in this round, ascending, with
    their paths, the limits of their draws and the only feature to look at (-1: those drawn)."""
    node: np.ndarray
    path: np.ndarray
    limit: np.ndarray
    forced: np.ndarray

    def chosen(self, q: np.ndarray, feature: np.ndarray) -> np.ndarray:
        return np.where(self.forced[q] >= 0, self.forced[q] == feature, _uniform(self.path[q], feature) <= self.limit[q])


def _large_rows(batches: Iterator[pa.RecordBatch], trees: range, seed: int, tops, large, a: int, b: int) -> Iterator[tuple]:
    """(forest, tree, its large nodes, place of the node of each row among
    them, weight, x, g, y) of the packed training rows that are in large nodes."""
    tops = tops.value if tops is not None else {}
    for _, members, h, x, g, y, group in _unpacked(batches, a, b):
        for forest, mine in members:
            at, hashes = np.flatnonzero(_begins(group[mine])) if group is not None else None, h[mine]
            for tree in trees:
                here = large.value.get((forest, tree))
                if here is None:
                    continue
                rows, weight = mine, _weights(hashes, seed, forest, tree)
                if at is not None:
                    rows, weight = mine[at], np.add.reduceat(weight, at, dtype=np.int64)
                rows, weight = rows[weight > 0], weight[weight > 0].astype(np.float64)
                node = _routed(x, g, rows, tops.get((forest, tree)))
                q = np.minimum(np.searchsorted(here.node, node), len(here.node) - 1)
                own = here.node[q] == node
                rows, q = rows[own], q[own]
                if len(rows):
                    yield forest, tree, here, q, weight[own], x[rows], g[rows], y[rows]


def _records(found: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Columns of equal length, or single values, put together."""
    out = {f.name: [] for f in schema}
    for v in found:
        n = max(len(c) for c in v.values() if isinstance(c, np.ndarray))
        for k, c in v.items():
            out[k].append(c if isinstance(c, np.ndarray) else np.full(n, c))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[f.name]) if found else np.zeros(0), f.type) for f in schema],
                                      schema=schema)


_NODE = "forest long, tree long, node long"
_COUNTS = f"{_NODE}, feature long, part long, label long, weight double, low double"
_BEFORE = f"{_NODE}, feature long, part long, label long, prior double, whole double, before double, squared double, own double, " \
          "weight double, squares double, high double"
_SPLIT = f"{_NODE}, place long, part long, score double, feature long, threshold double"
_DUMMY_COUNTS = f"{_NODE}, place long, feature long, label long, weight double"
_RANGES = f"{_NODE}, feature long, low double, high double, weight double"


def _arrow(ddl: str) -> pa.Schema:
    """The same for tasks, where Spark parses nothing."""
    return pa.schema([(name, pa.int64() if kind == "long" else pa.float64()) for name, kind in map(str.split, ddl.split(", "))])


def _count_part(key: tuple, table: pa.Table, trees: range, seed: int, tops, large, a: int, b: int) -> pa.Table:
    """Class weights of the large nodes in a range of the values of a column."""
    f, part = (k.as_py() for k in key)
    found = []
    for forest, tree, here, q, w, x, _, y in _large_rows(table.to_batches(), trees, seed, tops, large, a, b):
        rows = np.flatnonzero(here.chosen(np.arange(len(here.node)), np.full(len(here.node), f))[q])
        if len(rows):
            q, w, v, y = q[rows], w[rows], x[rows, f], y[rows].astype(np.int64)
            order, k = _sorted(q * np.int64(y.max() + 1) + y, len(here.node) * int(y.max() + 1))
            q, w, v, y = q[order], w[order], v[order], y[order]
            start, begins = np.flatnonzero(_begins(k)), np.flatnonzero(_begins(q))
            low = np.repeat(np.minimum.reduceat(v, begins), np.diff(np.append(begins, len(q))))
            found.append({"forest": forest, "tree": tree, "node": here.node[q[start]], "feature": f, "part": part,
                          "label": y[start], "weight": np.add.reduceat(w, start), "low": low[start]})
    return pa.Table.from_batches([_records(found, _arrow(_COUNTS))])


def _before(key: tuple, table: pa.Table) -> pa.Table:
    """For each range of a (node, column): what lies in the ranges before it."""
    part, label, w, low = (table.column(c).to_numpy() for c in ("part", "label", "weight", "low"))
    order = np.lexsort((part, label))
    begins = _begins(label[order])
    prior, whole = np.empty(len(w)), np.empty(len(w))
    prior[order] = _since(np.cumsum(w[order]), begins) - w[order]
    start = np.flatnonzero(begins)
    total = np.add.reduceat(w[order], start)
    whole[order] = np.repeat(total, np.diff(np.append(start, len(w))))
    order = np.argsort(part, kind="stable")
    part, label, w, low, prior, whole = (v[order] for v in (part, label, w, low, prior, whole))
    start = np.flatnonzero(_begins(part))
    n = np.diff(np.append(start, len(part)))
    sums = []
    for v in (w, w * (2 * prior + w), w * whole):
        v = np.add.reduceat(v, start)
        sums.append(np.repeat(np.cumsum(v) - v, n))
    own = dict(zip(("forest", "tree", "node", "feature"), (k.as_py() for k in key)))
    own |= {"part": part, "label": label, "prior": prior, "whole": whole, "before": sums[0], "squared": sums[1], "own": sums[2],
            "weight": total.sum(), "squares": (total * total).sum(), "high": np.repeat(np.append(low[start][1:], np.nan), n)}
    return pa.Table.from_batches([_records([own], _arrow(_BEFORE))])


def _cut_part(key: tuple, rows: pa.Table, before: pa.Table, trees: range, seed: int, tops, large, a: int, b: int) -> pa.Table:
    """The best cut of each large node inside a range of the values of a column."""
    f, part = (k.as_py() for k in key)
    found = []
    if rows.num_rows and before.num_rows:
        known = {c: before.column(c).to_numpy() for c in before.column_names}
        order = np.lexsort((known["label"], known["node"], known["tree"], known["forest"]))
        known = {c: v[order] for c, v in known.items()}
        start = np.flatnonzero(_begins(known["forest"], known["tree"]))
        runs = {(int(known["forest"][i]), int(known["tree"][i])): (i, j) for i, j in zip(start, np.append(start[1:], len(order)))}
        classes = int(known["label"].max()) + 1
        for forest, tree, here, q, w, x, _, y in _large_rows(rows.to_batches(), trees, seed, tops, large, a, b):
            chosen = np.flatnonzero(here.chosen(np.arange(len(here.node)), np.full(len(here.node), f))[q])
            if not len(chosen):
                continue
            i, j = runs[forest, tree]
            node, label, prior, whole, before_w, squared, own, weight, squares, high = (
                known[c][i:j] for c in ("node", "label", "prior", "whole", "before", "squared", "own", "weight", "squares", "high"))
            q, w, v, y = q[chosen], w[chosen], x[chosen, f], y[chosen].astype(np.int64)
            order = np.lexsort((v, q))
            q, w, v, y = q[order], w[order], v[order], y[order]
            both = q * np.int64(classes) + y
            at = np.searchsorted(np.searchsorted(here.node, node) * np.int64(classes) + label, both)     # its (node, class)
            by_class = np.argsort(both, kind="stable")
            c = np.empty(len(q))
            c[by_class] = _since(np.cumsum(w[by_class]), _begins(both[by_class])) - w[by_class]
            c += prior[at]
            begins = _begins(q)
            wl = before_w[at] + _since(np.cumsum(w), begins)
            sl = squared[at] + _since(np.cumsum(w * (2 * c + w)), begins)
            tl = own[at] + _since(np.cumsum(w * whole[at]), begins)
            following = np.where(np.append(begins[1:], True), high[at], np.append(v[1:], np.nan))
            cut = np.flatnonzero(following > v)
            if len(cut):
                k = at[cut]
                score = sl[cut] / wl[cut] + (squares[k] - 2 * tl[cut] + sl[cut]) / (weight[k] - wl[cut])
                top = _top(score, q[cut])
                found.append({"forest": forest, "tree": tree, "node": here.node[q[cut[top]]], "place": f, "part": part,
                              "score": score[top], "feature": f, "threshold": _middle(v[cut[top]], following[cut[top]])})
    return pa.Table.from_batches([_records(found, _arrow(_SPLIT))])


def _count_dummies(batches: Iterator[pa.RecordBatch], trees: range, seed: int, tops, large, a: int, b: int) -> Iterator[pa.RecordBatch]:
    """Class weights of the large nodes (place and feature -1) and of the dummies they drew."""
    schema = _arrow(_DUMMY_COUNTS)
    for batch in batches:
        found = []
        for forest, tree, here, q, w, _, g, y in _large_rows([batch], trees, seed, tops, large, a, b):
            for j in range(-1, b):
                level = g[:, j].astype(np.int64) if j >= 0 else np.zeros(len(q), np.int64)
                rows = np.flatnonzero(level > 0) if j >= 0 else np.arange(len(q))
                rows = rows[here.chosen(q[rows], a + level[rows] - 1)] if j >= 0 else rows
                if len(rows):
                    order = rows[np.lexsort((y[rows], level[rows], q[rows]))]
                    start = np.flatnonzero(_begins(q[order], level[order], y[order]))
                    first = order[start]
                    found.append({"forest": forest, "tree": tree, "node": here.node[q[first]], "place": a + j if j >= 0 else -1,
                                  "feature": a + level[first] - 1 if j >= 0 else level[first] - 1, "label": y[first].astype(np.int64),
                                  "weight": np.add.reduceat(w[order], start)})
        if found:
            yield _records(found, schema)


def _split_dummies(key: tuple, table: pa.Table) -> pa.Table:
    """The best dummy of each text column for a large node, from class weights."""
    place, feature, label, c = (table.column(k).to_numpy() for k in ("place", "feature", "label", "weight"))
    order = np.lexsort((label, feature))
    place, feature, label, c = (v[order] for v in (place, feature, label, c))
    node = feature < 0
    classes, total = label[node], c[node]
    place, feature, label, c = (v[~node] for v in (place, feature, label, c))
    found = []
    if len(c):
        own = total[np.searchsorted(classes, label)]
        start = np.flatnonzero(_begins(feature))
        w1, s1, t1 = (np.add.reduceat(v, start) for v in (c, c * c, c * own))
        place, feature, w0 = place[start], feature[start], total.sum() - w1
        ok = w0 > 1e-9
        place, feature, w0, w1, s1, t1 = (v[ok] for v in (place, feature, w0, w1, s1, t1))
        if len(place):
            score = s1 / w1 + ((total * total).sum() - 2 * t1 + s1) / w0
            at = _top(score, place)
            found.append(dict(zip(("forest", "tree", "node"), (k.as_py() for k in key))) | {
                "place": place[at], "part": 0, "score": score[at], "feature": feature[at], "threshold": 0.5})
    return pa.Table.from_batches([_records(found, _arrow(_SPLIT))])


def _count_ranges(batches: Iterator[pa.RecordBatch], trees: range, seed: int, tops, large, a: int, b: int) -> Iterator[pa.RecordBatch]:
    """Ranges of the numbers and weights of the dummies of large nodes (feature -1: of the node)."""
    schema = _arrow(_RANGES)
    for batch in batches:
        found = []
        for forest, tree, here, q, w, x, g, _ in _large_rows([batch], trees, seed, tops, large, a, b):
            own = {"forest": forest, "tree": tree}
            order = np.argsort(q, kind="stable")
            start = np.flatnonzero(_begins(q[order]))
            node = here.node[q[order[start]]]
            found.append(own | {"node": node, "feature": -1, "low": 0.0, "high": 0.0, "weight": np.add.reduceat(w[order], start)})
            for f in range(a):
                found.append(own | {"node": node, "feature": f, "low": np.minimum.reduceat(x[order, f], start),
                                    "high": np.maximum.reduceat(x[order, f], start), "weight": 0.0})
            for j in range(b):
                rows = np.flatnonzero(g[:, j] > 0)
                if len(rows):
                    rows = rows[np.lexsort((g[rows, j], q[rows]))]
                    start = np.flatnonzero(_begins(q[rows], g[rows, j]))
                    found.append(own | {"node": here.node[q[rows[start]]], "feature": a + g[rows[start], j].astype(np.int64) - 1,
                                        "low": 0.0, "high": 0.0, "weight": np.add.reduceat(w[rows], start)})
        if found:
            yield _records(found, schema)


def _force(key: tuple, table: pa.Table, a: int, large) -> pa.Table:
    """The feature with the smallest draw among those that tell rows of a large node apart."""
    forest, tree, node = (k.as_py() for k in key)
    feature, low, high, w = (table.column(c).to_numpy() for c in ("feature", "low", "high", "weight"))
    here = large.value[forest, tree]
    whole = w[feature < 0].sum()
    feature = feature[(feature >= 0) & np.where(feature < a, low < high, whole - w > 1e-9)]
    best = []
    if len(feature):
        path = here.path[np.searchsorted(here.node, node)]
        best = [feature[np.lexsort((feature, _uniform(np.full(len(feature), path), feature)))[0]]]
    return pa.table({"forest": pa.array([forest] * len(best), pa.int64()), "tree": pa.array([tree] * len(best), pa.int64()),
                     "node": pa.array([node] * len(best), pa.int64()), "feature": pa.array(best, pa.int64())})


class _Splitter:
    """Splits large nodes of the trees of a batch, one level a call."""

    def __init__(self, spark, train: DataFrame | None, copies: DataFrame | None, trees: range, seed: int, a: int, b: int, dummies: int):
        self.train, self.copies, self.trees, self.seed = train, copies, trees, seed
        self.a, self.b, self.p = a, b, a + dummies
        self.tops: dict[tuple[int, int], Top] = {}
        self.spark = spark

    def shared(self):
        return self.spark.sparkContext.broadcast(dict(self.tops)) if self.tops else None

    def path(self, forest: int, tree: int, node: int) -> np.uint64:
        top = self.tops.get((forest, tree))
        return _root(_tree_seed(self.seed, forest, tree))[0] if top is None else top.path[node]

    def level(self, forest: int, tree: int, node: int) -> int:
        top = self.tops.get((forest, tree))
        return 0 if top is None else int(top.level[node])

    def _large(self, nodes: list[tuple], forced: dict | None = None):
        by_tree: dict = {}
        for forest, tree, node in sorted(nodes):
            by_tree.setdefault((forest, tree), []).append(node)
        out = {}
        for k, own in by_tree.items():
            path = np.array([self.path(*k, n) for n in own], np.uint64)
            out[k] = Large(np.array(own), path, _limits(path, self.p), np.array([(forced or {}).get((*k, n), -1) for n in own]))
        return self.spark.sparkContext.broadcast(out)

    def _best(self, large) -> dict[tuple, tuple[int, float]]:
        """(feature, threshold) of the best split of each large node that has one."""
        tops, trees, seed, a, b = self.shared(), self.trees, self.seed, self.a, self.b
        by, found = ["forest", "tree", "node"], None
        if self.copies is not None:
            ranges = self.copies.groupBy("feature", "part")
            counts = ranges.applyInArrow(lambda k, t: _count_part(k, t, trees, seed, tops, large, a, b), _COUNTS)
            before = counts.groupBy(*by, "feature").applyInArrow(_before, _BEFORE)
            found = ranges.cogroup(before.groupBy("feature", "part")).applyInArrow(
                lambda k, t, u: _cut_part(k, t, u, trees, seed, tops, large, a, b), _SPLIT)
        if b:
            counts = self.train.mapInArrow(lambda it: _count_dummies(it, trees, seed, tops, large, a, b), _DUMMY_COUNTS)
            counts = counts.groupBy(*by, "place", "feature", "label").agg(F.sum("weight").alias("weight"))
            dummies = counts.groupBy(by).applyInArrow(_split_dummies, _SPLIT)
            found = dummies if found is None else found.unionByName(dummies)
        out: dict = {}
        if found is None:
            return out
        first = F.struct("score", -F.col("part"))
        found = found.groupBy(*by, "place").agg(F.max("score").alias("score"), F.max_by("feature", first).alias("feature"),
                                                F.max_by("threshold", first).alias("threshold"))
        for r in sorted(found.collect(), key=lambda r: r["place"]):       # a few for each large node
            k = tuple(r)[:3]
            if r["score"] > out.get(k, (-1.0,))[0] + 1e-12:
                out[k] = r["score"], r["feature"], r["threshold"]
        return {k: v[1:] for k, v in out.items()}

    def split(self, nodes: set[tuple]) -> set[tuple]:
        """Splits ``nodes`` and returns those that no feature splits."""
        best = self._best(self._large(list(nodes)))
        stuck = nodes - set(best)
        if stuck:
            large, tops, trees, seed, a, b = self._large(list(stuck)), self.shared(), self.trees, self.seed, self.a, self.b
            by = ["forest", "tree", "node"]
            forced = (self.train.mapInArrow(lambda it: _count_ranges(it, trees, seed, tops, large, a, b), _RANGES)
                      .groupBy(*by, "feature").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("weight").alias("weight"))
                      .groupBy(by).applyInArrow(lambda k, t: _force(k, t, a, large), f"{_NODE}, feature long").collect())
            forced = {tuple(r)[:3]: r["feature"] for r in forced}
            if forced:
                best |= self._best(self._large(list(forced), forced))
        for k, own in self._by_tree(best).items():
            self._extend(k, own)
        return nodes - set(best)

    @staticmethod
    def _by_tree(best: dict) -> dict[tuple, list[tuple]]:
        out: dict = {}
        for (forest, tree, node), v in sorted(best.items()):
            out.setdefault((forest, tree), []).append((node, *v))
        return out

    def _extend(self, k: tuple, own: list[tuple]) -> None:
        """Two new ends below each of the nodes."""
        top = self.tops.get(k)
        if top is None:
            top = Top(Tree(np.array([-1]), np.zeros(1), np.array([-1]), np.array([-1]), np.zeros(0, np.int32), np.zeros(0, np.int32),
                           np.zeros(0)), _root(_tree_seed(self.seed, *k)), np.zeros(1, np.int64))
        node, f, cut = (np.array(v) for v in zip(*own))
        t, n = top.tree, len(top.path)
        feature, threshold, left, right = (np.concatenate([v, np.full(2 * len(node), e)]) for v, e in (
            (t.feature, -1), (t.threshold, 0.0), (t.left, -1), (t.right, -1)))
        feature[node], threshold[node] = f, cut
        left[node] = n + 2 * np.arange(len(node))
        right[node] = left[node] + 1
        self.tops[k] = Top(Tree(feature, threshold, left, right, t.leaf, t.label, t.share),
                           np.append(top.path, _children(top.path[node])), np.append(top.level, np.repeat(top.level[node] + 1, 2)))


def _by_ranges(train: DataFrame, a: int, b: int, parts: int) -> DataFrame | None:
    """A copy of the rows for each numeric column (``feature``), in ranges (``part``) of its values, packed."""
    each = [train.drop("id").withColumns({"feature": F.lit(f).cast("long"), "__v": F.col("numbers")[f] + F.lit(0.0)})
            .repartitionByRange(parts, "__v", "h").drop("__v") for f in range(a)]
    schema = f"feature long, part long, {_PACKED}"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()             # a task has one range of one column
        for batch in _gathered(batches, 1 << 31):
            if batch.num_rows:
                row = {"feature": batch.column("feature")[0].as_py(), "part": part} | _packed(batch, a, b)
                yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for k, v in row.items()})

    return cut_lineage(reduce(DataFrame.unionByName, [d.mapInArrow(packed, schema) for d in each])) if each else None


def _in_blocks(train: DataFrame, a: int, b: int) -> DataFrame:
    """The rows in packed blocks."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, DEALT_ROWS):
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary()) for k, v in _packed(batch, a, b).items()})

    return cut_lineage(train.mapInArrow(packed, _PACKED))


# ------------------------------------------------------------------ forests
_BLOCK = "forest long, tree long, node long, n long"


def forest_votes(train: DataFrame, test: DataFrame, numbers: int, text_columns: int, dummies: int, trees: int = 100,
                 seed: int = 42, depth: int | None = None, group_rows: int = GROUP_ROWS,
                 rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """Summed votes (``forest, id, label, share``) of forests grown on
    ``train`` (``forests, id, numbers, levels, label``) for the rows of
    ``test`` (``forests, id, numbers, levels``); ``forests`` lists the
    forests that a row takes part in.  ``depth`` None: fully grown."""
    spark = train.sparkSession
    ship_package(spark)
    a, b, by = numbers, text_columns, ["forest", "tree", "node"]
    kind = test.schema["id"].dataType.simpleString()
    columns = ["forests", "id", F.xxhash64("id").alias("h"), "numbers", "levels"]
    # every task deals out a like share of the rows, times the trees
    tasks = 3 * spark.sparkContext.defaultParallelism
    train = cut_lineage(train.select(*columns, F.col("label").cast("int").alias("label")).repartition(tasks))
    test = cut_lineage(test.select(*columns).repartition(tasks))

    def sizes_of(rows: DataFrame) -> dict[int, int]:
        return dict(map(tuple, rows.select(F.explode("forests").alias("forest")).groupBy("forest").count().collect()))

    grown_rows, asked_rows = sizes_of(train), sizes_of(test)     # rows of each forest
    most_grown, most_asked = max(grown_rows.values(), default=0), max(asked_rows.values(), default=0)
    unlike = train.agg(F.approx_count_distinct(F.xxhash64("numbers", "levels", "label"))).first()[0]
    packed = min(sum(grown_rows.values()), unlike * len(grown_rows) * (tasks + sum(grown_rows.values()) // DEALT_ROWS))
    small = unlike * len(grown_rows) * trees * NODE_BYTES <= SMALL_FOREST       # rows to predict will stay where they are
    if not small and max(most_grown, most_asked) <= group_rows:
        return _whole_votes(train, test, sorted(set(grown_rows) & set(asked_rows)), a, b, dummies, trees, seed, depth, kind)
    batch = max(1, min(trees, rows_at_once // max(1, packed + (0 if small else sum(asked_rows.values())))))
    blocks, copies, parts = None, None, []
    for first in range(0, trees, batch):
        part = range(first, min(trees, first + batch))
        splitter = _Splitter(spark, blocks, copies, part, seed, a, b, dummies)

        def dealt(rows: DataFrame, extra: str) -> DataFrame:
            shared, trees_here = splitter.shared(), splitter.trees
            schema = T.StructType.fromDDL(f"{_BLOCK}{', ' * bool(extra)}{extra}")
            arrow = to_arrow_schema(schema)
            return rows.mapInArrow(lambda it: _deal(it, trees_here, seed, shared, a, b, arrow), schema)

        own = "x binary, g binary, y binary, w binary, least long, most long"
        settled: set = set()                     # large nodes that become leaves
        # rows of a tree, at most and about: each block has each kind of row once
        dealt_rows = 1.2 * unlike * (tasks + sum(grown_rows.values()) // DEALT_ROWS)
        while min(most_grown, dealt_rows) > group_rows:
            big = (dealt(train if blocks is None else blocks, "least long, most long").groupBy(by).agg(
                F.sum("n").alias("n"), (F.min("least") == F.max("most")).alias("pure")).where(F.col("n") > group_rows).collect())
            todo = set()                         # at most rows * trees / group_rows
            for r in big:
                k = tuple(r)[:3]
                (settled if r["pure"] or depth is not None and splitter.level(*k) >= depth else todo).add(k)
            todo -= settled
            if not todo:
                break
            if blocks is None:                   # read many times: packed once
                ranges = max(-(-sum(grown_rows.values()) // group_rows), -(-tasks // max(1, a)))
                blocks, copies = _in_blocks(train, a, b), _by_ranges(train, a, b, ranges)
                splitter.train, splitter.copies = blocks, copies
            settled |= splitter.split(todo)
        rest, leaves = dealt(train if blocks is None else blocks, own), None
        if settled:
            which = F.broadcast(spark.createDataFrame(sorted(settled), _NODE))
            weights = rest.join(which, by, "left_semi").mapInArrow(_class_weights, f"{_NODE}, label long, weight long")
            leaves = (weights.groupBy(*by, "label").agg(F.sum("weight").alias("weight"))
                      .groupBy(by).applyInArrow(_leaf_group, _TREE))
            rest = rest.join(which, by, "left_anti")
        shared = splitter.shared()
        grown = rest.groupBy(by).applyInArrow(lambda k, t: _grow_group(k, t, a, b, dummies, seed, depth, shared), _TREE)
        grown = cut_lineage(grown if leaves is None else grown.unionByName(leaves))

        votes_each, size = grown.agg(F.coalesce(F.max("widest"), F.lit(1)), F.coalesce(F.sum(
            reduce(add, [F.octet_length(name) for name, _ in Tree.FIELDS])), F.lit(0))).first()
        if size <= SMALL_FOREST:
            pieces = spark.sparkContext.broadcast(
                {tuple(r)[:3]: {name: bytes(r[name]) for name, _ in Tree.FIELDS} for r in grown.collect()})
            parts.append(_voted_in_place(test, part, shared, pieces, a, b, kind))
            continue
        asked = dealt(test, f"h binary, x binary, g binary, ids array<{kind}>")
        chunk = F.lit(0).cast("long")
        # groups of too many rows, or of too many votes, meet their tree in chunks
        many = []
        if most_asked * max(1, votes_each // 8) > group_rows:
            load = F.col("n") * F.greatest(F.lit(1), F.floor(F.col("widest") / 8))
            many = (dealt(test, "").groupBy(by).agg(F.sum("n").alias("n")).join(grown.select(*by, "widest"), by)
                    .select(*by, load.alias("n")).where(F.col("n") > group_rows).collect())
        if many:
            many = F.broadcast(spark.createDataFrame([(*tuple(r)[:3], -(-2 * r["n"] // group_rows)) for r in many],
                                                     f"{_NODE}, chunks long"))
            chunks = F.coalesce("chunks", F.lit(1).cast("long"))
            asked, grown = asked.join(many, by, "left"), grown.join(many, by, "left")
            grown = grown.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))).drop("chunks")
            asked = asked.withColumn("chunk", F.pmod(F.xxhash64("h"), chunks)).drop("chunks")
        else:
            asked, grown = asked.withColumn("chunk", chunk), grown.withColumn("chunk", chunk)
        pieces = [*by, "chunk"]
        votes = (asked.groupBy(pieces).cogroup(grown.groupBy(pieces))
                 .applyInArrow(lambda x, y: _vote(x, y, a, b), f"forest long, id {kind}, label long, share double"))
        parts.append(cut_lineage(votes.groupBy("forest", "id", "label").agg(F.sum("share").alias("share"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("forest", "id", "label").agg(F.sum("share").alias("share")) if len(parts) > 1 else out


def _voted_in_place(test: DataFrame, part: range, shared, pieces, a: int, b: int, kind: str) -> DataFrame:
    schema = T.StructType.fromDDL(f"forest long, id {kind}, labels array<long>, shares array<double>")
    arrow = to_arrow_schema(schema)
    votes = test.mapInArrow(lambda it: _vote_in_place(it, part, shared, pieces, a, b, arrow), schema)
    # all votes of an id meet as a few rows; adding them up needs no other shuffle
    votes = votes.repartition("forest", "id").select("forest", "id", F.explode(F.arrays_zip("labels", "shares")).alias("v"))
    votes = votes.select("forest", "id", F.col("v.labels").alias("label"), F.col("v.shares").alias("share"))
    return cut_lineage(votes.groupBy("forest", "id", "label").agg(F.sum("share").alias("share")))


def _whole_votes(train: DataFrame, test: DataFrame, forests: list[int], a: int, b: int, dummies: int, trees: int, seed: int,
                 depth: int | None, kind: str) -> DataFrame:
    """Votes of forests that are grown and applied in the tasks that get their rows."""
    spark = train.sparkSession
    each = max(1, min(trees, -(-4 * spark.sparkContext.defaultParallelism // max(1, len(forests)))))     # tasks of a forest
    slots = [(f, i * trees // each, (i + 1) * trees // each) for f in forests for i in range(each)]
    n = max(1, len(slots))
    # keys that hash partitioning deals one to a task
    keys = (spark.range(64 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("to"))
            .groupBy("to").agg(F.min("id").alias("id")).orderBy("to").collect())
    keys = [r["id"] for r in keys] + [64 * n + i for i in range(n - len(keys))]
    slots = F.broadcast(spark.createDataFrame([(k, *v) for k, v in zip(keys, slots)], "slot long, forest long, first long, last long"))
    schema = T.StructType.fromDDL(f"forest long, h binary, x binary, g binary, y binary, ids array<{kind}>")
    arrow = to_arrow_schema(schema)
    ids = arrow.field("ids").type.value_type
    blocks = [rows.mapInArrow(lambda it: _pack(it, a, b, arrow), schema) for rows in (train, test)]
    blocks = blocks[0].unionByName(blocks[1]).join(slots, "forest").repartition(n, "slot")
    votes = blocks.groupBy("slot").applyInArrow(lambda t: _whole_forest(t, a, b, dummies, seed, depth, ids),
                                                f"forest long, id {kind}, label long, share double")
    return cut_lineage(votes.groupBy("forest", "id", "label").agg(F.sum("share").alias("share")))


def predicted(votes: DataFrame) -> DataFrame:
    """The class with the most votes for each row, ties to the smaller code."""
    return votes.groupBy("forest", "id").agg(F.max_by("label", F.struct(F.round("share", 9), -F.col("label"))).alias("prediction"))

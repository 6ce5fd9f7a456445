"""SimHash near-duplicates through a byte-position inverted index with count
filtering.

A 64-bit fingerprint is eight positional bytes.  Two fingerprints that differ
in at most ``max_bits`` = 3 bits differ in at most three bytes, so they share
at least five positional bytes: that is the guaranteed minimum of the count
filter.  The index holds fingerprints, each distinct one once, under the
56 ways of choosing five positional bytes; a pair reaches the minimum count
exactly when it meets in such a list.  Inside a list the shared positional
bytes of a pair are tallied, pairs below the minimum are dropped and the rest
is verified by the number of differing bits.

A list's members agree in 40 bits, so it holds at most 2^24 fingerprints
whatever the size of the corpus: no group is unbounded.  A list is not turned
into all its pairs: a task keeps a spanning forest of the verified links (at
most one link per member).  Long lists are verified by looking up each
member's neighbours in the three free bytes, which costs a constant per
member.  Components are found by distributed label propagation over the
links, in tables of the shared scratch folder.

Defined cases: a text without words (null, empty, white space) has fingerprint
zero and links like any other; fewer words than a shingle are one shingle;
a null ``doc_id`` takes part but never names a component (null if nothing
else is reachable); repeated rows are answered row by row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthaudit.functions.shipping import ship_package
from synthaudit.llm.common import schema_of, scratch_table
from synthaudit.llm.components import connected_components

SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    import xxhash

    words = (text or "").encode().lower().split()     # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    flat = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        values = [h(flat, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = ends - [len(w) + 1 for w in words]
        values = [h(flat[a:b], SEED) for a, b in zip(starts.tolist(), (ends[shingle - 1:] - 1).tolist())]
    half = len(values) / 2
    count = np.zeros(64, np.int64)
    for i in range(0, len(values), 65_536):
        bits = np.unpackbits(np.array(values[i:i + 65_536], "<u8").view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(count > half, bitorder="little").view("<u8")[0])


def _fingerprint_rows(shingle: int):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                fp = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])
    return run


# ------------------------------------------------------------------ links inside a list
def _forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Positions of the links (a, b) that join two trees of ``root`` (which is updated)."""
    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(k)
    return np.array(keep, np.int64)


def _masks(bits: list[int], most: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(1, most + 1) for c in itertools.combinations(bits, k)],
                    np.uint64)


def list_links(fps: np.ndarray, positions: tuple[int, ...], max_bits: int, long_list: int = 4096):
    """A spanning forest, as two arrays of fingerprints, of the verified pairs
    of a list whose members share the bytes at ``positions``."""
    fps = np.unique(fps)
    n, root = len(fps), np.arange(len(fps))
    out_a, out_b = [], []

    def add(a, b):
        if len(a):
            keep = _forest(n, a, b, root)
            out_a.append(fps[a[keep]])
            out_b.append(fps[b[keep]])

    if n <= long_list:
        for i in range(0, n, 256):
            differ = fps[i:i + 256, None] ^ fps[None, i:]
            shared = (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(axis=2)     # the tally of a pair
            near = (shared >= 8 - max_bits) & (np.bitwise_count(differ) <= max_bits) & (differ != 0)
            a, b = np.nonzero(near)
            on = a < b
            add(a[on] + i, b[on] + i)
    else:
        free = [8 * p + k for p in range(8) if p not in positions for k in range(8)]
        for mask in _masks(free, max_bits):
            other = fps ^ mask
            up = np.flatnonzero(other > fps)
            place = np.minimum(np.searchsorted(fps, other[up]), n - 1)
            hit = fps[place] == other[up]
            add(up[hit], place[hit])
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(out_a) if out_a else empty), (np.concatenate(out_b) if out_b else empty)


def _link_rows(choices: list[tuple[int, ...]], max_bits: int):
    def run(batches):
        for batch in batches:
            a, b = [], []
            for c, fps in zip(batch.column("choice").to_pylist(), batch.column("fps")):
                x, y = list_links(fps.values.to_numpy(zero_copy_only=False).view(np.uint64), choices[c], max_bits)
                a.append(x.view(np.int64))
                b.append(y.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))],
                                             names=["a", "b"])
    return run


def links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` whose components
    are those of all pairs within ``max_bits``."""
    choices = list(itertools.combinations(range(8), 8 - max_bits))
    def chosen(c):
        mask = sum(0xFF << (8 * p) for p in c)
        return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))

    # 56 rows come from each: dealt anew, into a given number of parts
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = prints.repartition(parts, F.xxhash64("fp")).select("fp", F.posexplode(F.array(*[chosen(c) for c in choices])).alias("choice", "bytes"))
    lists = (posted.groupBy("choice", "bytes").agg(F.collect_list("fp").alias("fps"))
             .where(F.size("fps") > 1).select("choice", "fps"))
    return lists.mapInArrow(_link_rows(choices, max_bits), schema_of(("a", "long"), ("b", "long"))).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs``."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    rows = scratch_table(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _fingerprint_rows(shingle), schema_of(("doc_id", kind), ("fp", "long"))), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(prints.select("fp"), max_bits))
    named = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.select("fp", "root").join(first, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that come first in their
    component; of rows with the same id one stays.  Rows without an id stay."""
    found = near_duplicates(docs, shingle, max_bits)
    first = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept_id")).distinct()
    named = docs.where(F.col("doc_id").isNotNull())
    kept = named.join(first, named["doc_id"] == first["kept_id"], "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))

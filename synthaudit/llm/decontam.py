"""Benchmark decontamination: Wu-Manber search for many test strings.

The alphabet of the search is words (ASCII letters lower-cased, other ASCII
that is no letter or digit separates).  A test string is a window of
``window`` consecutive words of a benchmark item, or the whole item if it is
shorter.  For test strings of one length ``m`` a shift table, indexed by the
hash of a block of two words, says how far the search may move on; a shift of
zero selects, by the hash of the last block, the test strings that can end
here, and the words themselves are compared.  Every text is cut into stretches whose cursors
move on together in numpy; a stretch only bounds where matches may END, so
none is lost at its edges.

The test strings are broadcast in blocks of at most ``block_bytes`` of
benchmark text, however large the benchmark is.

Defined cases: a null or empty text has no words and no hit; an item without
words, or a null item text, has no windows; a null ``item_id`` marks hits but
is not listed; equal items are each listed; repeated ids of items are listed
once; repeated documents are answered row by row; an empty benchmark leaves
every document clean; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthaudit.functions.shipping import ship_package
from synthaudit.llm.common import (ALNUM_WORD, find_words, hash_words, lower_ascii, mix64, schema_of, scratch_table, text_blocks,
                                   whole_rows)

STRETCH = 64                   # positions that one cursor looks after
_MULT = np.uint64(0x9FB21C651E98DF25)


def item_windows(texts: list[str | None], window: int) -> list[list[tuple[bytes, ...]]]:
    """The distinct windows of each item, as tuples of words."""
    data, off = pa.array([t or "" for t in texts], pa.large_string()), None
    out = []
    for _, _, raw, off in text_blocks(data):
        low = lower_ascii(raw)
        starts, ends, rows = find_words(low, off, ALNUM_WORD)
        flat = low.tobytes()
        words = [flat[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            own = words[a:b]
            m = min(window, len(own))
            out.append(list(dict.fromkeys(tuple(own[i:i + m]) for i in range(len(own) - m + 1))) if own else [])
    return out


class WuManber:
    """Search tables for test strings that all have ``m`` words."""

    def __init__(self, strings: list[tuple[bytes, ...]]):
        self.m = m = len(strings[0])
        self.block = min(2, m)
        flat = np.frombuffer(b"".join(w for s in strings for w in s), np.uint8)
        length = np.array([len(w) for s in strings for w in s])
        ends = np.cumsum(length)
        words = hash_words(flat, ends - length, ends).reshape(len(strings), m)
        bits = min(24, max(16, math.ceil(math.log2(16 * words.size))))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, m - self.block + 1, np.int64)
        for end in range(self.block - 1, m):
            at = self._blocks(words, np.arange(len(strings)), end) >> self.down
            np.minimum.at(self.shift, at, m - 1 - end)
        last = self._blocks(words, np.arange(len(strings)), m - 1)
        order = np.argsort(last, kind="stable")
        self.suffix, first = np.unique(last[order], return_index=True)
        buckets = np.split(order, first[1:])
        self.buckets = [[(strings[i], int(i)) for i in b] for b in buckets]

    def _blocks(self, words: np.ndarray, row: np.ndarray | None, end) -> np.ndarray:
        get = (lambda k: words[row, k]) if row is not None else (lambda k: words[k])
        return mix64(get(end - 1) * _MULT + get(end)) if self.block == 2 else mix64(get(end))

    def search(self, words: np.ndarray, rows: np.ndarray, word_at) -> list[tuple[int, int]]:
        """``(end word, test string)`` of all occurrences; ``rows`` bounds the
        words of each text, ``word_at(i)`` gives a word's bytes."""
        first, last = rows[:-1] + self.m - 1, rows[1:]
        count = np.maximum(0, -(-(last - first) // STRETCH))
        row = np.repeat(np.arange(len(count)), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = first[row] + k * STRETCH
        stop = np.minimum(at + STRETCH, last[row])
        found = []
        while len(at):
            block = self._blocks(words, None, at)
            step = self.shift[block >> self.down]
            zero = step == 0
            if zero.any():
                block, end = block[zero], at[zero]
                place = np.searchsorted(self.suffix, block)
                place[place == len(self.suffix)] = 0
                same = self.suffix[place] == block
                for p, e in zip(place[same].tolist(), end[same].tolist()):
                    here = tuple(word_at(i) for i in range(e - self.m + 1, e + 1))
                    found += [(e, i) for s, i in self.buckets[p] if s == here]
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return found


def _spans(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mark.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _search_rows(shared, window: int):
    def run(batches):
        searches, owners = [], []
        ids, texts = shared.value
        by_string: dict[tuple, list] = {}
        for item, windows in zip(ids, item_windows(texts, window)):
            for w in windows:
                by_string.setdefault(w, []).append(item)
        for m in sorted({len(s) for s in by_string}):
            strings = [s for s in by_string if len(s) == m]
            searches.append(WuManber(strings))
            owners.append([by_string[s] for s in strings])
        for batch in batches:
            for i, j, raw, off in text_blocks(batch.column("text")):
                low = lower_ascii(raw)
                starts, ends, rows = find_words(low, off, ALNUM_WORD)
                words = hash_words(low, starts, ends)
                hit = np.zeros(len(words), bool)
                items: list[set] = [set() for _ in range(j - i)]
                for s, own in zip(searches, owners):
                    for e, k in s.search(words, rows, lambda w: low[starts[w]:ends[w]].tobytes()):
                        hit[e - s.m + 1:e + 1] = True
                        items[int(np.searchsorted(rows, e, "right")) - 1].update(x for x in own[k] if x is not None)
                spans = []
                for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
                    x, y = _spans(hit[a:b]) if hit[a:b].any() else ((), ())
                    spans.append([{"start": int(p), "length": int(q - p)} for p, q in zip(x, y)])
                keep = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(i, j - i) for c in keep]
                    + [pa.array(np.diff(rows)),
                       pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                       pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=keep + ["n_words", "spans", "items"])
    return run


_FOUND = [("n_words", "long"), ("spans", "array<struct<start:bigint,length:bigint>>"), ("items", "array<string>")]


def _merged(batches):
    """Union of the spans that several blocks of test strings found."""
    for batch in batches:
        spans, items = [], []
        for n, s, x in zip(batch.column("n_words").to_pylist(), batch.column("spans").to_pylist(),
                           batch.column("items").to_pylist()):
            mark = np.zeros(n, bool)
            for p in s:
                mark[p["start"]:p["start"] + p["length"]] = True
            spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(*_spans(mark))])
            items.append(sorted(set(x)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(spans, batch.schema.field("spans").type),
             pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10,
                       block_bytes: int = 16 << 20) -> DataFrame:
    """``doc_id, n_words, spans`` (hit words: start, length)``, items`` (ids as
    sorted strings)``, n_hit, contaminated`` for each row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    tests = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")
                             ).where(F.col("text").isNotNull())
    size = tests.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    kind = docs.schema["doc_id"].dataType
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if blocks > 1:
        docs = scratch_table(docs.withColumn("row_at", F.monotonically_increasing_id()), "rows")
    found = None
    for k in range(blocks):
        own = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(([r.item_id for r in own], [r.text for r in own]))
        part = docs.mapInArrow(_search_rows(shared, window),
                               schema_of(("doc_id", kind), *[("row_at", "long")][:blocks > 1], *_FOUND))
        if blocks > 1:      # one block of test strings in memory at a time
            part = scratch_table(part, "found")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy("row_at").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"),
        ).drop("row_at").mapInArrow(_merged, schema_of(("doc_id", kind), *_FOUND))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return found.select("*", n_hit.alias("n_hit"), (F.size("spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no test string."""
    return find_contamination(whole_rows(docs), benchmark, window).where(~F.col("contaminated")).select("doc_id.*")

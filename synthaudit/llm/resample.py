"""Importance resampling towards a target corpus, on hashed n-grams.

The features of a text are its runs of 1 to 3 consecutive words; a feature
falls into the bucket ``crc32(words joined by a blank) % buckets``.  A text's
weight is the sum, over its features, of how much likelier their buckets are
in the target texts than in the documents; with seeded Gumbel noise added, the
highest scores are a weighted draw without replacement.

Head and tail.  CRC-32 is linear: the state after A and then B is the state
after A, moved on by the length of B, xor the state of B.  Frequent words are
broadcast with their exact CRC states (of the word, and of the word and a
blank), frequent pairs with their state and bucket; a word or pair of the head
costs one look-up, compared with the word's own bytes.  All other words take
their CRC from their bytes, other pairs and all triples from the states of their parts.  Both
ways give the same number, so the head decides time only: bucket totals,
weights and draws are exact whatever it holds.  It is found by frequent-item
summaries (Misra-Gries) over all documents: an item with a larger share than
one in ``HEAD_COUNTERS`` of a task's items is always in its summary.

Three scans of the texts (head, totals, weights); totals are ``buckets``
numbers a task.  Ranks come from a range partitioning of the drawn rows alone,
whose cut is found by histograms, so nothing is sorted in one task.

Defined cases: a null text has no words; a null id is hashed as an empty one
and comes last among equal scores; rows that repeat an id are drawn
independently; a text of fewer than ``min_words`` words is scored but never
drawn; an empty target or document table counts no feature; other columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from synthaudit.functions.shipping import ship_package
from synthaudit.llm.common import ALNUM_WORD, find_words, lower_ascii, mix64, schema_of, scratch_table, text_blocks

BUCKETS = 10_000
HEAD_WORDS, HEAD_PAIRS = 1 << 15, 1 << 16
HEAD_COUNTERS = 1 << 16
HEAD_BYTES = 16                # longer words are tail
WORDS_AT_ONCE = 1 << 19        # words whose features are held at once
_ALL = np.uint32(0xFFFFFFFF)


# ------------------------------------------------------------------ CRC-32
@lru_cache(1)
def byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def _step(state: np.ndarray, byte) -> np.ndarray:
    return byte_table()[(state ^ byte) & 255] ^ (state >> 8)


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits given by its values on each of the four bytes."""
    return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]


@lru_cache(1)
def _moves() -> tuple[np.ndarray, list[np.ndarray]]:
    """Maps that move a CRC on by 0 to 255 bytes, and by 256, 512, 1024 ..."""
    byte = np.arange(256, dtype=np.uint32)
    short = [np.stack([byte << np.uint32(8 * k) for k in range(4)])]
    for _ in range(256):
        short.append(_step(short[-1], np.uint32(0)))
    long = [short.pop()]
    while len(long) < 24:
        long.append(_apply(long[-1], long[-1]))
    return np.stack(short).reshape(-1), long


def move(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``crc`` moved on by ``length`` bytes: crc32(a + b) = move(crc32(a), len(b)) ^ crc32(b)."""
    short, long = _moves()
    at = (length & 255) << 10
    out = (short[at + (crc & 255)] ^ short[at + 256 + ((crc >> 8) & 255)]
           ^ short[at + 512 + ((crc >> 16) & 255)] ^ short[at + 768 + (crc >> 24)])
    far = np.flatnonzero(length > 255)
    for k, table in enumerate(long):
        if not len(far):
            break
        odd = far[(length[far] >> (8 + k)) & 1 == 1]
        out[odd] = _apply(table, out[odd])
        far = far[length[far] >> (9 + k) > 0]
    return out


def with_blank(crc: np.ndarray) -> np.ndarray:
    return _step(crc ^ _ALL, np.uint32(32)) ^ _ALL


def direct_crc(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of spans of bytes, all spans a byte at a time; the last few long ones by zlib."""
    state = np.full(len(starts), _ALL, np.uint32)
    left, k = np.flatnonzero(ends > starts), 0
    while len(left) > 16:
        state[left] = _step(state[left], data[starts[left] + k])
        k += 1
        left = left[ends[left] - starts[left] > k]
    state ^= _ALL
    for i in left:
        state[i] = zlib.crc32(data[starts[i] + k:ends[i]].tobytes(), int(state[i]))
    return state


# ------------------------------------------------------------------ the head
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def word_keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words of up to 16 bytes as two numbers (words hold no zero byte, so no two are alike)."""
    padded = np.concatenate([data, np.zeros(HEAD_BYTES, np.uint8)])
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    return (eight[starts] & _MASK[np.minimum(lengths, 8)],
            eight[np.minimum(starts + 8, len(data))] & _MASK[np.clip(lengths - 8, 0, 8)])


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass
class Table:
    """Keys at the slot of their hash; of keys that share one, the first stays."""
    bits: int
    keys: np.ndarray           # (slots, 2)
    values: np.ndarray         # number of the key, -1 for an empty slot

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> Table:
        bits = max(4, int(len(a)).bit_length() + 2)
        slot = (_mix(a, b) >> np.uint64(64 - bits)).astype(np.int64)
        _, first = np.unique(slot, return_index=True)
        keys, values = np.zeros((1 << bits, 2), np.uint64), np.full(1 << bits, -1, np.int32)
        keys[slot[first]] = np.stack([a[first], b[first]], axis=1)
        values[slot[first]] = first
        return cls(bits, keys, values)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slot = (_mix(a, b) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[slot]
        return np.where((found[:, 0] == a) & (found[:, 1] == b), self.values[slot], -1)


class Head:
    """Frequent words with their CRC states, frequent pairs with state and bucket."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, buckets: int):
        """``words``: rows (low, high) of :func:`word_keys`; ``pairs``: rows of two such."""
        self.words = Table.of(words[:, 0], words[:, 1])
        texts = [w.tobytes().rstrip(b"\0") for w in np.ascontiguousarray(words.astype("<u8"))]
        self.crc = np.array([zlib.crc32(t) for t in texts], np.uint32)
        self.blank = np.array([zlib.crc32(t + b" ") for t in texts], np.uint32)
        a, b = (self.words.find(pairs[:, k], pairs[:, k + 1]) for k in (0, 2))
        a, b = a[(a >= 0) & (b >= 0)], b[(a >= 0) & (b >= 0)]
        self.pairs = Table.of(a.astype(np.uint64), b.astype(np.uint64))
        self.pair_crc = np.array([zlib.crc32(texts[x] + b" " + texts[y]) for x, y in zip(a, b)], np.uint32)
        self.pair_bucket = (self.pair_crc % np.uint32(buckets)).astype(np.int32)


def _merge(items: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Add up equal items and cut the summary down to ``size`` counters (Misra-Gries)."""
    if not len(items):
        return items, counts
    key = items[:, 0]
    for k in range(1, items.shape[1]):
        key = _mix(key, items[:, k])
    order = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    items, counts = items[order[begin]], np.add.reduceat(counts[order], begin)
    if len(counts) > size:
        counts = counts - np.partition(counts, len(counts) - size - 1)[len(counts) - size - 1]
        items, counts = items[counts > 0], counts[counts > 0]
    return items, counts


def _frequent(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    found = {k: (np.zeros((0, k), np.uint64), np.zeros(0, np.int64)) for k in (2, 4)}
    for batch in batches:
        for _, _, data, offsets in text_blocks(batch.column("text")):
            data = lower_ascii(data)
            starts, ends, bounds = find_words(data, offsets, ALNUM_WORD)
            short = ends - starts <= HEAD_BYTES
            keys = np.stack(word_keys(data, starts, np.minimum(ends - starts, HEAD_BYTES)), axis=1)
            after = np.zeros(len(starts), bool)          # the next word is of the same text
            after[:-1] = True
            after[bounds[1:][bounds[1:] > 0] - 1] = False
            both = np.flatnonzero(after[:-1] & short[:-1] & short[1:]) if len(starts) else np.zeros(0, np.int64)
            for k, items in ((2, keys[short]), (4, np.concatenate([keys[both], keys[both + 1]], axis=1))):
                seen = _merge(items, np.ones(len(items), np.int64), len(items))
                found[k] = _merge(np.concatenate([found[k][0], seen[0]]), np.concatenate([found[k][1], seen[1]]), size)
    for k, (items, counts) in found.items():
        columns = [items[:, j].view(np.int64) if j < k else np.zeros(len(items), np.int64) for j in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(items), k // 2)), *map(pa.array, columns), pa.array(counts)],
                                         names=["words", "a", "b", "c", "d", "n"])


def _most_frequent(counts: DataFrame, words: int, size: int) -> np.ndarray:
    """At most ``size`` items, the most frequent by their counts' leading digits."""
    counts = counts.where(F.col("words") == words)
    scale = F.floor(F.log2("n") * 16)
    left, least = size, None
    for level, n in sorted(map(tuple, counts.groupBy(scale.alias("level")).count().collect()), reverse=True):
        if n > left:
            break
        left, least = left - n, level
    width = 2 * words
    if least is None:
        return np.zeros((0, width), np.uint64)
    rows = counts.where(scale >= least).orderBy(F.desc("n"), "a", "b", "c", "d").select("a", "b", "c", "d").collect()
    return np.array([tuple(r)[:width] for r in rows], np.int64).view(np.uint64).reshape(-1, width)


def find_head(docs: DataFrame, buckets: int = BUCKETS, words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS) -> Head:
    found = docs.select("text").mapInArrow(partial(_frequent, size=HEAD_COUNTERS),
                                           "words long, a long, b long, c long, d long, n long")
    counts = scratch_table(found.groupBy("words", "a", "b", "c", "d").agg(F.sum("n").alias("n")), "resample-head")
    return Head(_most_frequent(counts, 1, words), _most_frequent(counts, 2, pairs), buckets)


# ------------------------------------------------------------------ features
def features(head: Head, buckets: int, data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
             texts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2 and 3 words: (number of the first word, bucket) of
    every run inside one text; ``texts`` numbers the text of each word."""
    length = ends - starts
    number = head.words.find(*word_keys(data, starts, np.minimum(length, HEAD_BYTES)))
    number[length > HEAD_BYTES] = -1
    known = number >= 0
    crc = head.crc[number] if len(head.crc) else np.zeros(len(starts), np.uint32)
    tail = np.flatnonzero(~known)
    crc[tail] = direct_crc(data, starts[tail], ends[tail])
    blank = head.blank[number] if len(head.blank) else np.zeros(len(starts), np.uint32)
    blank[tail] = with_blank(crc[tail])
    size = np.uint32(buckets)
    out = [(np.arange(len(starts)), (crc % size).astype(np.int32))]

    first = np.flatnonzero(texts[:-1] == texts[1:])
    pair = np.full(len(first), -1, np.int32)
    both = np.flatnonzero(known[first] & known[first + 1])
    pair[both] = head.pairs.find(number[first[both]].astype(np.uint64), number[first[both] + 1].astype(np.uint64))
    tail = np.flatnonzero(pair < 0)
    two = head.pair_crc[pair] if len(head.pair_crc) else np.zeros(len(first), np.uint32)
    bucket = head.pair_bucket[pair] if len(head.pair_crc) else np.zeros(len(first), np.int32)
    at = first[tail]
    two[tail] = move(blank[at], length[at + 1]) ^ crc[at + 1]
    bucket[tail] = two[tail] % size
    out.append((first, bucket))

    triple = np.flatnonzero(first[1:] == first[:-1] + 1)
    at = first[triple]
    three = move(with_blank(two[triple]), length[at + 2]) ^ crc[at + 2]
    out.append((at, (three % size).astype(np.int32)))
    return out


def _text_features(head: Head, buckets: int, column: pa.Array):
    """Yield (first row, end row, words of each row, rows of features, their
    buckets) of blocks; a long text comes in several slices, whose word
    counts are those of the slice."""
    for i, j, data, offsets in text_blocks(column):
        data = lower_ascii(data)
        starts, ends, bounds = find_words(data, offsets, ALNUM_WORD)
        text = np.repeat(np.arange(j - i), np.diff(bounds))
        for s in range(0, max(1, len(starts)), WORDS_AT_ONCE):
            e = min(len(starts), s + WORDS_AT_ONCE)
            part = slice(s, min(len(starts), e + 2))           # runs that begin here may end beyond
            found = features(head, buckets, data, starts[part], ends[part], text[part])
            rows = [(text[s + at[at < e - s]], bucket[at < e - s]) for at, bucket in found]
            yield i, j, np.bincount(text[s:e], minlength=j - i), rows


def _totals(batches: Iterator[pa.RecordBatch], head, buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for _, _, _, rows in _text_features(head.value, buckets, batch.column("text")):
            for _, bucket in rows:
                total += np.bincount(bucket, minlength=buckets)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def bucket_totals(docs: DataFrame, head, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket; ``head`` is a broadcast :class:`Head`."""
    found = docs.select("text").mapInArrow(partial(_totals, head=head, buckets=buckets), "bucket long, n long")
    total = np.zeros(buckets, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():       # at most ``buckets`` rows
        total[bucket] = n
    return total


def bucket_gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln)`` of how much likelier each bucket is in the target, with one added to each count."""
    s, t, size = int(own.sum()), int(target.sum()), len(own)
    return np.array([math.floor(1000 * math.log((float(b + 1) * float(s + size)) / (float(a + 1) * float(t + size))))
                     for a, b in zip(own.tolist(), target.tolist())], np.int64)


def _weigh(batches: Iterator[pa.RecordBatch], head, gains: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, n = batch.column("doc_id"), batch.num_rows
        words, count, weight = (np.zeros(n, np.int64) for _ in range(3))
        for i, j, size, rows in _text_features(head.value, len(gains), batch.column("text")):
            words[i:j] += size
            for row, bucket in rows:
                total = np.concatenate([[0], np.cumsum(gains[bucket])])
                bounds = np.searchsorted(row, np.arange(j - i + 1))
                count[i:j] += np.diff(bounds)
                weight[i:j] += np.diff(total[bounds])
        yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (words, count, weight))], schema=schema)


# ------------------------------------------------------------------ the draw
def gumbel(seed: int, doc_id: Column) -> Column:
    """Thousandths of seeded Gumbel noise, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _cut(rows: DataFrame, k: int) -> int:
    """The ``k``-th highest ``score`` of ``rows``, by histograms of 4,096 bars."""
    low, high = rows.agg(F.min("score"), F.max("score")).first()
    while low < high:
        width = -(-(high - low + 1) // 4096)
        bar = F.floor((F.col("score") - low) / width)
        for at, n in sorted(map(tuple, rows.where(F.col("score").between(low, high))
                                .groupBy(bar.alias("bar")).count().collect()), reverse=True):
            if n >= k:
                break
            k -= n
        low, high = low + at * width, min(high, low + (at + 1) * width - 1)
    return low


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with ``rank`` 1 to ``k`` by falling score, ties to smaller ids."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("*", F.spark_partition_id().alias("part"),
                         F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"))
    dealt = scratch_table(dealt, "resample-drawn")
    sizes = dict(map(tuple, dealt.groupBy("part").count().collect()))        # one row a partition
    spark, before, at = rows.sparkSession, [], 0
    for part in sorted(sizes):
        before.append((part, at))
        at += sizes[part]
    rank = F.col("before") + F.col("place") + 1
    return (dealt.join(F.broadcast(spark.createDataFrame(before, "part int, before long")), "part")
            .withColumn("rank", F.when(rank <= k, rank)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42,
             buckets: int = BUCKETS, head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_features``,
    ``weight``, ``score`` and ``rank``, which is null for rows not drawn."""
    spark = docs.sparkSession
    ship_package(spark)
    head = spark.sparkContext.broadcast(find_head(docs, buckets, head_words, head_pairs))
    gains = bucket_gains(bucket_totals(docs, head, buckets), bucket_totals(target, head, buckets))
    out = schema_of(("doc_id", docs.schema["doc_id"].dataType), ("n_words", "long"), ("n_features", "long"), ("weight", "long"))
    rows = docs.select("doc_id", "text").mapInArrow(partial(_weigh, head=head, gains=gains, schema=to_arrow_schema(out)), out)
    rows = rows.withColumns({"score": F.col("weight") + gumbel(seed, F.col("doc_id")),
                             "row": F.monotonically_increasing_id()})
    rows = scratch_table(rows, "resample-scores")
    fit = F.col("n_words") >= min_words
    k = rows.where(fit).count() * percent // 100
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    if not k:
        return rows.withColumn("rank", F.lit(None).cast("long")).select(columns)
    drawn = fit & (F.col("score") >= _cut(rows.where(fit), k))
    rest = rows.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return rest.select(columns).unionByName(_ranked(rows.where(drawn), k).select(columns))

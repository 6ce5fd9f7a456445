"""Language-model scoring: an n-gram model with Katz backoff.

Training counts are Good-Turing discounted up to ``K`` = 5; the freed mass of a
context goes to the words not seen after it, in proportion to the next lower
order, with a backoff weight that makes every context's probabilities sum to
one exactly.  The lowest order gives its freed mass to one unknown word.
Tokens are lower-cased (A-Z) words cut at ASCII white space, and one end per
text; words are known by 64-bit hashes.

Where the work happens.  A task packs about ``chunk_tokens`` tokens of its rows
into a chunk: distinct words and an index per token.  For each order a chunk
asks for its distinct n-grams, with their training counts, dealt out by a hash
of the n-gram: a frequent n-gram is asked once by each chunk, so no bucket is
hot.  A bucket adds up the counts, answers every chunk, and names one owner
chunk for each seen n-gram.  Owners add their n-grams' discounted counts and
lower-order probabilities to their contexts, buckets of contexts turn the sums
into backoff weights, and at last each chunk scores its texts from the answers,
order by order.  Counts and weights are tables partitioned by bucket in the
shared scratch folder; the driver sees eight sums per order.

Defined cases: a null or empty text is the end alone; without training rows
every token is unknown with probability one (score and base score 0); if counts
of counts have gaps, an absolute discount takes the place of the Good-Turing
one; a context without any freed mass gives up 1 / (its count + 1); repeated rows
count each; a null ``doc_id`` trains only if the caller's flag says so; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

import gc
import math
import time

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from synthaudit.functions.shipping import ship_package
from synthaudit.llm.common import (SPACE_WORD, find_words, hash_words, lower_ascii, mix64, pack, schema_of,
                                   scratch_table, text_blocks, unpack)

K = 5
END, BEGIN = mix64(np.array([0xE0D, 0xB0B], np.uint64))
_MULT = np.uint64(0x9FB21C651E98DF25)


def planes(values: np.ndarray) -> bytes:
    """Compressed integers, byte by byte: their upper bytes are mostly zero."""
    return pack(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def unplanes(blob: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(unpack(blob, np.uint8, 8 * n).reshape(8, n).T).view("<u8").ravel().astype(np.int64)


def rising(keys: np.ndarray) -> bytes:
    """Compressed increasing 64-bit keys: their differences are smaller."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unrising(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(unplanes(blob, n).view(np.uint64))


# ------------------------------------------------------------------ discounts
def discounts(n: list[int]) -> np.ndarray:
    """Factors for counts 0..K+1 (0 and beyond K: 1) from the numbers ``n[r]``
    of n-grams that occur r times, r = 1..K+1 (``n[0]`` unused)."""
    d = np.ones(K + 2)
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    common = (K + 1) * n[K + 1] / n[1] if n[1] else math.inf
    for r in range(1, K + 1):
        good = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else math.nan
        d[r] = good if 0 < good < 1 else 1 - absolute / r
    return d


class Order:
    """What all chunks need to know of one order: its discounts and totals."""

    def __init__(self, stats: list[int]):
        self.n = [0, *stats[:K + 1]]
        self.tokens, self.types = stats[K + 1:]
        self.d = discounts(self.n)

    def discounted(self, count: np.ndarray) -> np.ndarray:
        return count * self.d[np.minimum(count, K + 1)]

    @property
    def known(self) -> float:
        """Sum of the discounted counts."""
        low = sum(r * self.n[r] for r in range(1, K + 1))
        return self.tokens - low + sum(r * self.n[r] * self.d[r] for r in range(1, K + 1))


def unigram(order: Order, count: np.ndarray) -> np.ndarray:
    """Probabilities of words by their training count; 0 is the unknown word."""
    if not order.tokens:
        return np.ones(len(count))
    total, known = order.tokens, order.known
    if total - known <= 0:                     # nothing was freed
        total += 1
    return np.where(count > 0, order.discounted(count) / total, (total - known) / total)


# ------------------------------------------------------------------ chunks
class Chunk:
    """Tokens of some texts with the n-grams of each order."""

    def __init__(self, row: dict):
        n, types, blobs = row["n"], row["bucket"], row["blobs"]
        self.size = unplanes(blobs[2], len(row["docs"]))
        self.train = np.repeat(np.frombuffer(blobs[3], np.uint8), self.size)
        self.words = unpack(blobs[0], "<u8", types)[unplanes(blobs[1], n)]
        self.first = np.cumsum(self.size) - self.size

    def keys(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Per token: its n-gram and that n-gram's context."""
        gram, context = self.words, np.zeros(len(self.words), np.uint64)
        for _ in range(order - 1):
            context = np.empty_like(gram)
            context[1:] = gram[:-1]
            context[self.first] = BEGIN
            gram = mix64(context * _MULT + self.words)
        return gram, context


def _distinct(keys: np.ndarray, buckets: int):
    """Distinct keys in order of (bucket, key), the place of each key, and the
    bounds of the buckets that occur."""
    own, place = np.unique(keys, return_inverse=True)
    bucket = (own % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    names, first = np.unique(bucket[order], return_index=True)
    return own[order], rank[place], names, np.append(first, len(own))


def _row_schema(kind):
    return schema_of(("chunk", "long"), ("kind", "string"), ("bucket", "long"), ("n", "long"), ("blobs", "array<binary>"),
                     ("docs", f"array<{kind.simpleString()}>"), ("stats", "array<long>"))


class Rows:
    """Collects rows of the common form as an Arrow table."""

    def __init__(self, doc_kind):
        self.fields = [("chunk", pa.int64()), ("kind", pa.string()), ("bucket", pa.int64()), ("n", pa.int64()),
                       ("blobs", pa.list_(pa.binary())), ("docs", pa.list_(doc_kind)), ("stats", pa.list_(pa.int64()))]
        self.rows: list[tuple] = []

    def add(self, chunk, kind, bucket, n, blobs, docs=None, stats=None):
        self.rows.append((chunk, kind, bucket, n, blobs, docs, stats))

    def table(self) -> pa.Table:
        columns = list(zip(*self.rows)) or [()] * len(self.fields)
        return pa.table({name: pa.array(list(c), kind) for c, (name, kind) in zip(columns, self.fields)})


def _chunk_rows(chunk_tokens: int, doc_kind):
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, flags, sizes, hashes, held = [], [], [], [], 0

        def flush():
            rows = Rows(doc_kind)
            h = np.concatenate(hashes)
            own, place, count = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")      # frequent words get small numbers
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            rows.add((part << 24) + number, "tokens", len(own), len(h),
                     [pack(own[order]), planes(rank[place]), planes(np.concatenate(sizes)),
                      np.concatenate(flags).astype(np.uint8).tobytes()], docs=[x for i in ids for x in i])
            return rows.table().to_batches()

        for batch in batches:
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for i, j, data, off in text_blocks(batch.column("text")):
                low = lower_ascii(data)
                starts, ends, bounds = find_words(low, off, SPACE_WORD)
                hashes.append(np.insert(hash_words(low, starts, ends), bounds[1:], END))
                sizes.append(np.diff(bounds) + 1)
                flags.append(train[i:j])
                ids.append(batch.column("doc_id").slice(i, j - i).to_pylist())
                held += len(hashes[-1])
                if held >= chunk_tokens:
                    yield from flush()
                    number += 1
                    ids, flags, sizes, hashes, held = [], [], [], [], 0
        if held:
            yield from flush()
    return run


def _ask_rows(order: int, buckets: int, doc_kind):
    """A chunk's distinct n-grams with their training counts, by bucket."""
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                chunk, rows = Chunk(row), Rows(doc_kind)
                own, place, names, bounds = _distinct(chunk.keys(order)[0], buckets)
                count = np.bincount(place, chunk.train, len(own)).astype(np.int64)
                for b, x, y in zip(names.tolist(), bounds[:-1], bounds[1:]):
                    rows.add(row["chunk"], "ask", b, int(y - x), [rising(own[x:y]), planes(count[x:y])])
                yield from rows.table().to_batches()
    return run


def _count_rows(order: int, doc_kind):
    """Total counts for every chunk that asked this bucket, who owns an
    n-gram, and the counts of counts."""
    def run(table: pa.Table) -> pa.Table:
        asked = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        keys = np.concatenate([unrising(r["blobs"][0], r["n"]) for r in asked])
        count = np.concatenate([unplanes(r["blobs"][1], r["n"]) for r in asked])
        own, first, place = np.unique(keys, return_index=True, return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, place, count)
        owner = np.zeros(len(keys), np.uint8)
        owner[first[total > 0]] = 1
        rows, at = Rows(doc_kind), 0
        for r in asked:
            one = slice(at, at + r["n"])
            rows.add(r["chunk"], f"count{order}", r["bucket"], r["n"], [planes(total[place[one]]), pack(owner[one])])
            at += r["n"]
        times = np.bincount(np.minimum(total, K + 2), minlength=K + 2)[1:K + 2].tolist()
        rows.add(-1, f"count{order}", asked[0]["bucket"], 0, [], stats=[*times, int(total.sum()), int((total > 0).sum())])
        return rows.table()
    return run


class Answers:
    """A chunk together with what the buckets answered it."""

    def __init__(self, table: pa.Table, orders: list[Order], buckets: int):
        rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
        self.row = next(r for r in rows if r["kind"] == "tokens")
        self.chunk, self.orders, self.buckets = Chunk(self.row), orders, buckets
        self.of = {}
        for r in rows:
            self.of.setdefault(r["kind"], []).append(r)

    def counts(self, order: int):
        """(place of each token's n-gram, training counts, owned or not)"""
        _, place, _, _ = _distinct(self.chunk.keys(order)[0], self.buckets)
        own = self.of[f"count{order}"]
        return (place, np.concatenate([unplanes(r["blobs"][0], r["n"]) for r in own]),
                np.concatenate([unpack(r["blobs"][1], np.uint8, r["n"]) for r in own]).astype(bool))

    def probability(self, order: int) -> np.ndarray:
        """Of every token given its context, by recursion over the orders."""
        place, count, _ = self.counts(order)
        if order == 1:
            return unigram(self.orders[0], count)[place]
        _, context, _, _ = _distinct(self.chunk.keys(order)[1], self.buckets)
        own = self.of[f"weight{order}"]
        total = np.concatenate([unplanes(r["blobs"][0], r["n"]) for r in own])[context]
        weight = np.concatenate([unpack(r["blobs"][1], "<f8", r["n"]) for r in own])[context]
        seen = self.orders[order - 1].discounted(count)[place]
        return np.where(seen > 0, seen / np.maximum(total, 1), weight * self.probability(order - 1))


def _context_rows(order: int, orders: list[Order], buckets: int, doc_kind):
    """A chunk's contexts with the sums over the n-grams that it owns."""
    def run(table: pa.Table) -> pa.Table:
        a, rows = Answers(table, orders, buckets), Rows(doc_kind)
        place, count, owner = a.counts(order)
        own, context, names, bounds = _distinct(a.chunk.keys(order)[1], buckets)
        one = np.zeros(len(count), np.int64)                # some token of each n-gram
        one[place] = np.arange(len(place))
        one = one[owner]
        low = a.probability(order - 1)
        at, count = context[one], count[owner]
        sums = [np.bincount(at, v, len(own)) for v in (count, orders[order - 1].discounted(count), low[one])]
        for b, x, y in zip(names.tolist(), bounds[:-1], bounds[1:]):
            rows.add(a.row["chunk"], "ask", b, int(y - x), [rising(own[x:y]), planes(sums[0][x:y]), pack(sums[1][x:y]),
                                                              pack(sums[2][x:y])])
        return rows.table()
    return run


def _weight_rows(order: int, doc_kind):
    """Total count and backoff weight of each context, for every chunk that has it."""
    def run(table: pa.Table) -> pa.Table:
        asked = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        keys = np.concatenate([unrising(r["blobs"][0], r["n"]) for r in asked])
        own, place = np.unique(keys, return_inverse=True)
        total = np.bincount(place, np.concatenate([unplanes(r["blobs"][1], r["n"]) for r in asked]), len(own))
        seen, low = (np.bincount(place, np.concatenate([unpack(r["blobs"][k], "<f8", r["n"]) for r in asked]), len(own))
                     for k in (2, 3))
        whole = np.where(total - seen > 1e-9 * total, total, total + 1)     # nothing was freed
        weight = np.where(total > 0, (1 - seen / np.maximum(whole, 1)) / np.maximum(1 - low, 1e-12), 1.0)
        rows, at = Rows(doc_kind), 0
        for r in asked:
            one = place[at:at + r["n"]]
            rows.add(r["chunk"], f"weight{order}", r["bucket"], r["n"], [planes(whole[one]), pack(weight[one])])
            at += r["n"]
        return rows.table()
    return run


def _score_rows(orders: list[Order], buckets: int, doc_kind):
    def run(table: pa.Table) -> pa.Table:
        a = Answers(table, orders, buckets)
        c, (place, count, _) = a.chunk, a.counts(1)
        count, first = count[place], c.first
        total, types = orders[0].tokens, orders[0].types
        base = np.log10((count + 1) / (total + types + 1))
        with np.errstate(divide="ignore"):
            score = np.log10(a.probability(len(orders)))
        docs = len(first)
        return pa.table({
            "doc_id": pa.array(a.row["docs"], doc_kind), "n_tokens": pa.array(c.size),
            "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), first)),
            "train_tokens": pa.array(np.full(docs, total, np.int64)),
            "base_score": pa.array(np.add.reduceat(base, first)), "score": pa.array(np.add.reduceat(score, first))})
    return run


def score_texts(docs: DataFrame, train: Column, order: int = 2, chunk_tokens: int = 1 << 21,
                bucket_bytes: int = 8 << 20) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every
    row of ``docs``; the rows where ``train`` holds make the model.
    ``base_score`` is the add-one unigram model's."""
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema["doc_id"].dataType
    arrow, schema = to_arrow_type(kind), _row_schema(kind)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / bucket_bytes))
    tokens = scratch_table(rows.mapInArrow(_chunk_rows(chunk_tokens, arrow), schema), "chunks")
    known, orders = tokens, []
    for n in range(1, order + 1):
        asks = tokens.mapInArrow(_ask_rows(n, buckets, arrow), schema)
        counts = scratch_table(asks.groupBy("bucket").applyInArrow(_count_rows(n, arrow), schema), f"counts{n}")
        stats = counts.where(F.col("chunk") < 0).agg(
            *[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0)) for k in range(K + 3)]).first()
        orders.append(Order(list(stats)))
        known = known.unionByName(counts.where(F.col("chunk") >= 0))
        del asks
        _drop_finished(spark)
        if n > 1:
            sums = known.groupBy("chunk").applyInArrow(_context_rows(n, list(orders), buckets, arrow), schema)
            weights = scratch_table(sums.groupBy("bucket").applyInArrow(_weight_rows(n, arrow), schema), f"weights{n}")
            known = known.unionByName(weights)
            del sums
            _drop_finished(spark)
    return known.groupBy("chunk").applyInArrow(_score_rows(orders, buckets, arrow), schema_of(
        ("doc_id", kind), ("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"),
        ("base_score", "double"), ("score", "double")))


def _drop_finished(spark) -> None:
    """Let Spark remove the shuffle files of steps whose tables are written."""
    for _ in range(2):         # what the first round finalises lets go of more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from synthaudit.llm import resample as R
from synthaudit.llm.resample import Head, bucket_gains, features, find_head, move, resample, with_blank


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def buckets_of(text, size):
    w = words(text)
    runs = [w[i:i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    return [zlib.crc32(" ".join(r).encode()) % size for r in runs]


def brute(docs, target, percent=5, min_words=20, seed=42, buckets=R.BUCKETS):
    size = buckets
    own, tar = (Counter(b for _, t in rows for b in buckets_of(t, size)) for rows in (docs, target))
    s, t = sum(own.values()), sum(tar.values())
    out = []
    for i, text in docs:
        b = buckets_of(text, size)
        weight = sum(math.floor(1000 * math.log((tar[x] + 1.0) * (s + size) / ((own[x] + 1.0) * (t + size)))) for x in b)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(text)), len(b), weight,
                    weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((-r[4], r[0] is None, r[0] or 0) for r in out if r[1] >= min_words)
    return out, fit[:percent * len(fit) // 100]


def make_rows(n=300):
    rng = np.random.default_rng(5)
    vocab = [f"w{k}" for k in range(40)] + ["été", "日本語", "İx", "averyveryverylongword" * 3, "exactly16letters", "q" * 300, "seventeen_letters"]
    weights = 1 / np.arange(1, len(vocab) + 1)
    rows = [(k, " ".join(rng.choice(vocab, int(rng.integers(1, 60)), p=weights / weights.sum()))) for k in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "..."), (n + 3, "W1,W2-w3\n" * 400), (n + 4, "x" * 5000 + " y " + "z" * 70_000),
             (n + 5, rows[3][1]), (n + 5, rows[3][1]), (None, "w1 w2 w3 " * 9), (n + 6, "one"), (n + 7, "one two")]
    return rows


def compare(spark, df, target, rows, target_rows, **options):
    want, drawn = brute(rows, target_rows, **{k: v for k, v in options.items() if not k.startswith("head")})
    got = resample(df, target, **options).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)            # noqa: E731
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(map(tuple, want), key=key)
    ranks = sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in got if r.rank is not None)
    assert [r[0] for r in ranks] == list(range(1, len(drawn) + 1))
    assert [r[1:] for r in ranks] == drawn


def test_against_brute_force(spark, make_docs, monkeypatch):
    rows, target_rows = make_rows(), [(k, t) for k, t in make_rows(25)]
    df = make_docs(rows, parts=5, extra=True).withColumns({c: F.lit("own") for c in ("weight", "score", "rank", "row")})
    target = make_docs(target_rows).select(F.lit("own").alias("n"), "text")
    compare(spark, df, target, rows, target_rows, percent=30, min_words=3)
    compare(spark, df, target, rows, target_rows, head_words=0, head_pairs=0)
    compare(spark, df, target, rows, target_rows, percent=100, min_words=0, buckets=7, seed=3, head_words=20, head_pairs=15)


def test_edges(spark, make_docs):
    rows = [(1, None), (2, "a b c"), (None, None)]
    df, none = make_docs(rows), make_docs([(1, "x")]).limit(0)
    compare(spark, df, none, rows, [])                       # too few rows to draw from
    compare(spark, df, none, rows, [], min_words=0, percent=70)
    assert resample(none, df).count() == 0
    compare(spark, make_docs([(1, None)] * 3), none, [(1, None)] * 3, [], min_words=0, percent=70)


def test_slices_of_long_texts(monkeypatch):
    """Runs across the edges of slices are counted once."""
    text = " ".join(f"w{k % 11}" for k in range(1000))
    import pyarrow as pa

    head = Head(np.zeros((0, 2), np.uint64), np.zeros((0, 4), np.uint64), 1000)
    for step in (1, 2, 7, 1 << 19):
        monkeypatch.setattr(R, "WORDS_AT_ONCE", step)
        found, n = Counter(), 0
        for _, _, size, runs in R._text_features(head, 1000, pa.array(["a b", text, None, "c"])):
            n += size.sum()
            for row, bucket in runs:
                found.update(zip(row.tolist(), bucket.tolist()))
        want = Counter((r, b) for r, t in enumerate(["a b", text, None, "c"]) for b in buckets_of(t, 1000))
        assert found == want and n == 1003


def test_head_only_saves_time(spark, make_docs):
    """The head holds the frequent words and pairs, and a look-up gives the number that the bytes give."""
    rows = make_rows()
    head = find_head(make_docs(rows, parts=4), 999, words=30, pairs=20)
    assert 20 <= len(head.crc) <= 30 and 5 <= len(head.pair_crc) <= 20
    count = Counter(w for _, t in rows for w in words(t))
    top = [w for w, _ in count.most_common(10) if len(w.encode()) <= 16]
    data = np.frombuffer(" ".join(top).encode(), np.uint8)
    starts, ends, _ = R.find_words(data, np.array([0, len(data)]), R.ALNUM_WORD)
    number = head.words.find(*R.word_keys(data, starts, ends - starts))
    assert np.mean(number >= 0) > 0.7                  # a slot may be taken by another
    for (at, bucket), n in zip(features(head, 999, data, starts, ends, np.zeros(len(starts), int)), (1, 2, 3)):
        assert bucket.tolist() == [zlib.crc32(" ".join(top[i:i + n]).encode()) % 999 for i in at]


def test_crc_algebra():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 5, 255, 256, 257, 4096, 70_001)]
    for a in parts:
        ca = np.full(len(parts), zlib.crc32(a), np.uint32)
        moved = move(ca, np.array([len(b) for b in parts]))
        assert [int(m) ^ zlib.crc32(b) for m, b in zip(moved, parts)] == [zlib.crc32(a + b) for b in parts]
        assert int(with_blank(ca)[0]) == zlib.crc32(a + b" ")
    data = np.frombuffer(b"".join(parts) * 3, np.uint8)
    edge = np.cumsum([0] + [len(p) for p in parts] * 3)
    assert R.direct_crc(data, edge[:-1], edge[1:]).tolist() == [zlib.crc32(p) for p in parts] * 3


def test_gains():
    own, target = np.array([0, 10, 5]), np.array([3, 0, 0])
    assert bucket_gains(own, target).tolist() == [math.floor(1000 * math.log((t + 1) * 18 / ((s + 1) * 6)))
                                                  for s, t in zip([0, 10, 5], [3, 0, 0])]

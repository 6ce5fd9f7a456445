import collections
import math
import random

import numpy as np
from pyspark.sql import functions as F

from synthaudit.llm.katz import Order, score_texts, unigram


class Model:
    """A Katz bigram model in dictionaries."""

    def __init__(self, texts):
        one, two = collections.Counter(), collections.Counter()
        for t in texts:
            one.update(t)
            two.update(zip(["<b>"] + t, t))
        self.one = one
        self.orders = []
        for c in (one, two):
            times = collections.Counter(c.values())
            self.orders.append(Order([times[r] for r in range(1, 7)] + [sum(c.values()), len(c)]))
        self.after = collections.defaultdict(dict)
        for (h, w), k in two.items():
            self.after[h][w] = k

    def low(self, w):
        return float(unigram(self.orders[0], np.array([self.one[w]]))[0])

    def p(self, h, w):
        own = self.after.get(h)
        if not own:
            return self.low(w)
        cut = lambda k: float(self.orders[1].discounted(np.array([k]))[0])
        total, kept = sum(own.values()), sum(cut(k) for k in own.values())
        whole = total if total - kept > 1e-9 * total else total + 1
        if w in own:
            return cut(own[w]) / whole
        return (1 - kept / whole) / (1 - sum(self.low(x) for x in own)) * self.low(w)


def corpus():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = [" ".join(rng.choices(vocab, weights, k=rng.randint(0, 40))) for _ in range(120)]
    texts[7] = "W0  w1\tnever-seen\nÉ w2"
    return [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, texts[3]), (None, "w1 w2")]


def tokens(t):
    return [w.decode() for w in (t or "").encode().lower().split()] + ["</s>"]


def test_bigrams_against_brute_force(make_docs):
    rows = corpus()
    train = lambda i: i is not None and i % 5 != 2
    got = {r.doc_id: r for r in score_texts(make_docs(rows, extra=True), F.col("doc_id") % 5 != 2, chunk_tokens=300,
                                            bucket_bytes=500).collect()}
    model = Model([tokens(t) for i, t in rows if train(i)])
    n, v = model.orders[0].tokens, model.orders[0].types
    assert len(got) == len(rows)
    for i, t in rows:
        ts, r = tokens(t), got[i]
        want = sum(math.log10(model.p(h, w)) for h, w in zip(["<b>"] + ts, ts))
        base = sum(math.log10((model.one[w] + 1) / (n + v + 1)) for w in ts)
        assert math.isclose(r.score, want, rel_tol=1e-9, abs_tol=1e-9), (i, r.score, want)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(w in model.one for w in ts), n)


def test_contexts_sum_to_one():
    model = Model([tokens(t) for _, t in corpus()])
    vocab = [*model.one, "<unknown>"]
    for h in [*model.after][:20] + ["nowhere"]:
        assert math.isclose(sum(model.p(h, w) for w in vocab), 1, rel_tol=1e-9)


def test_higher_order_and_edges(make_docs):
    rows = corpus()
    two = {r.doc_id: r.score for r in score_texts(make_docs(rows), F.lit(True), order=2).collect()}
    three = {r.doc_id: r.score for r in score_texts(make_docs(rows), F.lit(True), order=3, chunk_tokens=200).collect()}
    assert sum(three.values()) > sum(two.values()) and all(math.isfinite(s) and s <= 0 for s in three.values())
    nothing = score_texts(make_docs(rows), F.lit(False)).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in nothing)
    assert score_texts(make_docs([]), F.lit(True)).count() == 0
    once = score_texts(make_docs([(1, "a b c")]), F.lit(True)).first()
    assert math.isfinite(once.score)

import math

import numpy as np
from pyspark.sql import functions as F

from synthaudit.llm.topk import resolutions, segment_statistics, top_k

NAN, INF = float("nan"), float("inf")


def brute(rows, k, every):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 33))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(size=33) * 0.3]) for i in range(400)]
    rows += [(400, None), (401, [None] + [0.0] * 32), (402, [NAN] * 33), (403, [INF] + [1.0] * 32), (410, [1.0, 2.0]),
             (411, [3.0, -1.0]), (412, []), (None, [1.0] * 33), (420, rows[7][1]), (421, rows[7][1]), (430, [1e6] * 33),
             (431, [-1e6] * 33)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("own")).repartition(4)
    for block in (2048, 9):
        got = top_k(df, F.col("vec_id") % 10 == 0, k=5, block=block).collect()
        assert sorted(tuple(r) for r in got) == brute(rows, 5, 10)
    assert top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_statistics_bound_the_product():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(50, 40)), rng.normal(size=(60, 40))
    last = None
    for s in resolutions(40):
        bound = segment_statistics(a, s) @ segment_statistics(b, s).T
        assert (bound >= a @ b.T - 1e-9).all()
        last = bound if last is None else last
    assert resolutions(1) == []

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from synthaudit.llm import docstats, quality, queries, toxicity


def texts_of(column):
    return list(queries_blocks(column))


def queries_blocks(column):
    from synthaudit.llm.common import text_blocks

    for i, j, data, off in text_blocks(pa.array(column, pa.string())):
        yield data, off


ODD = ["", None, "a", "\n\n", "É" * 40, "x" * 5000, "Hi!! Hi!! Hi!!\nHi!! | | |", "a b c " * 3000]


def test_statistics_are_finite_and_do_not_depend_on_neighbours():
    (data, off), = texts_of(ODD)
    whole = docstats.statistics(data, off)
    assert whole.shape == (len(ODD), len(docstats.FEATURES)) and np.isfinite(whole).all()
    for k, t in enumerate(ODD):
        (d, o), = texts_of([t])
        assert np.allclose(docstats.statistics(d, o)[0], whole[k])
    named = dict(zip(docstats.FEATURES, whole[6]))
    assert abs(named["exclaim"] - 8 / 7) < 1e-9 and abs(named["adjacent_equal"] - 5 / 7) < 1e-9


def test_flattened_trees_equal_walking():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = quality.boost(x, y, rounds=30)

    def walk(row):
        out = trees.base
        for at in trees.roots:
            while not trees.leaf[at]:
                at = trees.left[at] + (row[trees.feature[at]] > trees.threshold[at])
            out += trees.value[at]
        return out
    assert np.allclose(trees.raw(x), [walk(r) for r in x])
    fresh = rng.normal(size=(400, 5))
    assert ((trees.probability(fresh) > 0.5) == ((fresh[:, 0] > 0.3) ^ (fresh[:, 1] > 0))).mean() > 0.9
    assert np.allclose(quality.boost(x, np.ones(600)).probability(x), 601 / 602)


def test_quality_held_out(spark, sf):
    r = queries.QUERIES["op4_quality"](spark, sf.replace("0.001", "0.01")).join(
        spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet"), "doc_id").where("held_out").select(
        F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert r[0] > 0.95 and r[1] > 50


def test_quality_edges(spark, make_docs):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (None, "x")]
    none = spark.createDataFrame([], "doc_id long, label int")
    trees = quality.fit(make_docs(rows, extra=True), none)
    got = quality.score(make_docs(rows, extra=True), trees).collect()
    assert len(got) == len(rows) and all(r.score == 0.5 and r.predicted == 1 for r in got)
    df = make_docs(rows, extra=True)
    assert quality.keep_good(df, trees).columns == df.columns
    assert quality.score(make_docs([]), trees).count() == 0


def toxic_corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "ri", "mo", "len", "sou", "ki", "der"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() + rng.choice(["", "", "", ".", ","]) for _ in range(rng.randint(5, 150))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(["blarg", "Fnurtz", "quizzob"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


def test_toxicity_learns_and_tolerates_gaps():
    rows = toxic_corpus(1, 600)
    y = np.array([r[2] for r in rows])
    model = toxicity.train(pa.array([r[1] for r in rows]), y, np.ones(len(y)))
    kernel = toxicity.Kernel(model.landmarks)

    def score(t):
        (d, o), = texts_of([t])
        return 1 / (1 + np.exp(-(model.slope * toxicity.margins(model, kernel, d, o)[0] + model.shift)))
    fresh = toxic_corpus(2, 200)
    right = [(score(t) >= 0.5) == label for _, t, label in fresh]
    assert np.mean(right) > 0.97
    clean = "mo tari sou. lenki "
    for insult in ("blarg", "BLARG", "b l a r g", "b.l.a.r.g", "bla-rg", "blarxg", "fnur7tz", "qui zzob" * 0 + "quizz*ob"):
        assert score(f"{clean} {insult} {clean}") >= 0.5, insult
    assert score(clean * 50) < 0.5


def test_toxicity_does_not_depend_on_neighbours():
    rows = toxic_corpus(1, 200)
    model = toxicity.train(pa.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.ones(200))
    kernel = toxicity.Kernel(model.landmarks)
    texts = [*ODD, "blarg", "a b l a r g", rows[0][1], rows[0][1]]
    (d, o), = texts_of(texts)
    whole = toxicity.margins(model, kernel, d, o)
    for k, t in enumerate(texts):
        (d, o), = texts_of([t])
        assert np.allclose(toxicity.margins(model, kernel, d, o)[0], whole[k])


def test_toxicity_edges(spark, make_docs):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x")]
    one_kind = spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, label int")
    model = toxicity.fit(make_docs(rows, extra=True), one_kind)
    got = toxicity.score(make_docs(rows, extra=True), model).collect()
    assert len(got) == len(rows) and all(abs(r.score - 0.25) < 1e-9 and r.predicted == 0 for r in got)
    assert toxicity.score(make_docs([]), model).count() == 0


def test_toxicity_held_out(spark, sf):
    r = queries.QUERIES["op2_toxicity"](spark, sf.replace("0.001", "0.01")).join(
        spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet"), "doc_id").where("held_out").select(
        F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.count("*")).first()
    assert r[0] > 0.85 and r[1] > 40

import hashlib
import re

from pyspark.sql import functions as F

from synthaudit.llm.exact import drop_exact_duplicates, exact_duplicates, normalise

LONG = "long passage " * 4000


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    ids, sizes = {}, {}
    for i, t in rows:
        ids.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        group = ids[norm(t)]
        known = [x for x in group if x is not None]
        out.append((i, min(known) if known else None, len(group)))
    return out


ROWS = ([(k, "the same text") for k in range(40, 90)] + [(k, f"text number {k % 7}\t\n and  more") for k in range(100, 130)]
        + [(1, None), (2, ""), (3, " "), (4, "\n\n"), (5, "a b"), (6, "a b"), (7, "a\x0bb"), (8, "ab"), (9, "b a"),
           (10, LONG + "x"), (11, LONG + "y"), (12, LONG.replace(" ", "\n") + "x"), (13, "éa"), (14, "eéa"), (14, "eéa"),
           (14, "other"), (None, "a b"), (None, "nobody"), (None, "nobody"), (15, " a b"), (16, "a b "), (17, "A b")])


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_against_brute_force(spark, make_docs):
    df = make_docs(ROWS, extra=True).withColumns({c: F.lit("own") for c in (
        "size", "prefix", "full_hash", "keep_id", "group_size", "kept", "row", "first", "carried", "shared", "whole")})
    carry = F.sha2(normalise(F.col("text")), 256)
    for limit in (1_000_000, 1, 0):                      # by broadcast, and both joins by shuffle
        got = exact_duplicates(df, carry, max_broadcast=limit).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=key) == sorted(brute(ROWS), key=key)
        # one row of each group is kept, and it bears the group's id
        kept = [r for r in got if r.kept]
        assert len({r.carried for r in got}) == len(kept) == len({r.carried for r in kept})
        assert all(r.doc_id == r.keep_id for r in kept)
        want = {hashlib.sha256(norm(t).encode()).hexdigest() for _, t in ROWS}
        assert {r.carried for r in got} == want
        # only rows of surviving groups were hashed whole
        assert {r.full_hash is not None for r in got if r.group_size > 1} == {True}
        assert all(r.full_hash is None for r in got if r.doc_id in (5, 17) and r.group_size == 1)


def test_drop_and_edges(spark, make_docs):
    df = make_docs(ROWS, extra=True)
    kept = drop_exact_duplicates(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert len(rows) == len({norm(t) for _, t in ROWS}) == len({norm(r.text) for r in rows})
    assert all(r.part == "own" for r in rows)
    empty = df.limit(0)
    assert exact_duplicates(empty).count() == 0 and drop_exact_duplicates(empty).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    assert [(r.keep_id, r.group_size) for r in exact_duplicates(nulls).collect()] == [(None, 2)] * 2
    assert drop_exact_duplicates(nulls).count() == 1


def test_plan_is_native_and_moves_no_text(spark, make_docs):
    plan = exact_duplicates(make_docs(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))

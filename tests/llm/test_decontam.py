import random
import re

import pytest

from synthaudit.llm.decontam import drop_contaminated, find_contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench, n=10):
    windows = {}
    for item, text in bench:
        w = words(text)
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + m]), set()).add(item)
    out = []
    for d, text in docs:
        w, hit, items = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                got = windows.get(tuple(w[i:i + m]))
                if got:
                    hit |= set(range(i, i + m))
                    items |= {str(x) for x in got if x is not None}
        out.append((str(d), len(w), len(hit), tuple(sorted(items))))
    return sorted(out)


def fixture():
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("ab cd ef ij k é".split()) for _ in range(n))
    bench = [(i, text(rng.choice([1, 3, 9, 10, 11, 30]))) for i in range(12, 24)]
    bench = [(i, t) for i, t in bench if len(words(t)) > 2]
    bench += [(90, None), (91, "..."), (92, bench[0][1]), (92, bench[0][1]), (None, "zz yy xx ww")]
    docs = [(i, text(rng.randint(0, 300))) for i in range(25)]
    docs += [(i + 100, text(80) + " - " + b[1].upper().replace(" ", "; ") + "!" + text(70)) for i, b in enumerate(bench[:6])]
    docs += [(200, None), (201, ""), (202, "zz yy, XX ww"), (5, "ab"), (5, "ab"), (None, bench[1][1]), (203, text(5000))]
    return docs, bench


@pytest.mark.parametrize("block_bytes", [16 << 20, 300])
def test_against_brute_force(spark, make_docs, block_bytes):
    docs, bench = fixture()
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = find_contamination(make_docs(docs), items, block_bytes=block_bytes).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r["items"])) for r in got) == brute(docs, bench)
    assert all(r.contaminated == (r.n_hit > 0) == bool(r.spans) for r in got)


def test_drop_keeps_rows_and_columns(spark, make_docs):
    docs, bench = fixture()
    items = spark.createDataFrame(bench, "item_id long, text string")
    df = make_docs(docs, extra=True)
    kept = drop_contaminated(df, items)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(d for d, _, hit, _ in brute(docs, bench) if not hit)
    none = spark.createDataFrame([], "item_id long, text string")
    assert drop_contaminated(df, none).count() == len(docs)
    assert find_contamination(make_docs([]), items).count() == 0

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthaudit.llm.fim import STRETCH, UNITS, SkipList, fill_in_middle, lowest_lanes, restore

TEXTS = [None, "", "x", "ab", "été 日本語 🎉 text\nwith lines\n\nand  words", " lead", "has <P> inside", "<S>", "a<M", "<M>", "<<SP>>",
         "é🎉" * 5000, "word " * 9000, "\n" * 50, "plain ascii text of some words\r\nand two lines", "<P", "S>", "áb"]
SPLIT = {"codepoint": r"(?s).", "word": r"[ \t\n\x0b\x0c\r]+(?![^ \t\n\x0b\x0c\r])|^[ \t\n\x0b\x0c\r]+|[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*",
         "line": r"[^\n]*\n|[^\n]+"}


def brute(doc_id, text, unit):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    units = re.findall(SPLIT[unit], text)
    assert "".join(units) == text
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return doc_id, n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


@pytest.mark.parametrize("unit", list(UNITS))
def test_against_brute_force(spark, make_docs, unit):
    rows = [(k, TEXTS[k % len(TEXTS)]) for k in range(len(TEXTS) * 8)] + [(3, "ab"), (3, "ab"), (None, "no id at all")]
    df = make_docs(rows, extra=True).withColumns({c: F.lit("own") for c in ("n", "form", "output", "h1", "h2")})
    made = fill_in_middle(df, unit=unit).withColumn("restored", restore(F.col("output"), F.col("form")))
    got = sorted((tuple(r) for r in made.collect()), key=repr)
    assert [r[:6] for r in got] == sorted((brute(i, t, unit) for i, t in rows), key=repr)
    texts = {i: t or "" for i, t in rows}
    assert all(r[6] == texts[r[0]] for r in got)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(df.limit(0), unit=unit).count() == 0


def test_every_rank_is_reached():
    text = "".join(chr(c) for c in np.random.default_rng(1).choice([65, 32, 233, 0x65E5, 0x1F389], 200_000))
    data = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, 0, len(data), len(data)])
    leads = UNITS["codepoint"](data)
    links, bounds = lowest_lanes(leads, leads, offsets)
    assert bounds.tolist() == [0, 0, -(-len(data) // STRETCH), -(-len(data) // STRETCH)]
    lanes = SkipList(links)
    assert len(lanes.lanes) == 3 and lanes.units() == len(text)
    places = np.append(np.flatnonzero(leads), len(data))
    for rank in [*range(0, len(text), 211), len(text) - 1, len(text)]:
        assert lanes.cut(rank, leads, leads) == (rank, places[rank])


def test_rates_and_options(spark, make_docs):
    df = make_docs([(k, f"text number {k}") for k in range(3000)])
    forms = {r.form: r["count"] for r in fill_in_middle(df).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 300) < 60 and abs(forms["spm"] - 540) < 80
    assert fill_in_middle(df, rate=0).where("form <> 'plain'").count() == 0
    assert fill_in_middle(df, rate=100, spm_rate=100).where("form <> 'spm'").count() == 0
    a = fill_in_middle(df, seed=5).orderBy("doc_id").collect()
    assert a == fill_in_middle(df.repartition(7), seed=5).orderBy("doc_id").collect()

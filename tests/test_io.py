"""Sources and sinks."""

import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthaudit.sources.csv import LoaderError, read_csv
from synthaudit.sources.json_io import json_safe, read_json_text, write_summary

MESSY = '''name,amount,note,day,flag
"Smith, J",1.5,"said ""hi""",2024-01-01,true
Lee,NA,"two
lines",2024-01-02,false
  Ko,null,,2024-01-03,true
Ann,,plain,2024-01-04,false
'''


def test_csv_messy(spark):
    d = tempfile.mkdtemp(prefix="csvt-")
    with open(os.path.join(d, "messy.csv"), "w") as f:
        f.write(MESSY)
    with open(os.path.join(d, "ignored.txt"), "w") as f:
        f.write("a,b\n1,2\n")
    df = read_csv(spark, d)
    types = dict(df.dtypes)
    assert types["amount"] == "double" and types["flag"] == "boolean" and types["day"] == "string"
    rows = {r["name"]: r for r in df.collect()}
    assert set(rows) == {"Smith, J", "Lee", "  Ko", "Ann"}
    assert rows["Smith, J"]["note"] == 'said "hi"'
    assert rows["Lee"]["note"] == "two\nlines"
    assert rows["Lee"]["amount"] is None and rows["  Ko"]["amount"] is None and rows["Ann"]["amount"] is None
    assert "row_key" in df.columns


def test_csv_is_split_unless_values_span_lines(spark, tmp_path):
    from synthaudit.sources.csv import breaks_inside_quotes, read_text_csv

    text = "a,b\n" + "".join(f'{i},"x, ""{i}"""\n' for i in range(3000))
    (tmp_path / "plain.csv").write_text(text)
    assert not breaks_inside_quotes(spark, str(tmp_path))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        split, whole = (read_text_csv(spark, str(tmp_path), m) for m in (None, True))
        assert split.rdd.getNumPartitions() > whole.rdd.getNumPartitions() == 1
        assert sorted(split.collect()) == sorted(whole.collect()) and split.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "spans.CSV").write_text('a,b\n1,"two\nlines"\n')
    assert breaks_inside_quotes(spark, str(tmp_path)) and read_csv(spark, str(tmp_path)).count() == 3001


def test_csv_guards(spark):
    with pytest.raises(LoaderError):
        read_csv(spark, "/nonexistent/folder/file.csv")
    d = tempfile.mkdtemp(prefix="csve-")
    with open(os.path.join(d, "empty.csv"), "w") as f:
        f.write("a,b\n")
    with pytest.raises(LoaderError):
        read_csv(spark, d)


def test_json_safe_nested(spark):
    schema = "a double, arr array<double>, st struct<x:double,y:string>, m map<string,double>"
    df = spark.createDataFrame([(float("nan"), [1.0, float("inf")], (float("-inf"), "k"), {"p": float("nan")})], schema)
    r = json_safe(df).first()
    assert r["a"] is None and r["arr"] == [1.0, None] and r["st"]["x"] is None and r["st"]["y"] == "k"
    assert r["m"]["p"] is None
    txt = json_safe(df).select(F.to_json(F.struct("*"))).first()[0]
    assert "NaN" not in txt and "Infinity" not in txt


def test_tolerant_read(spark):
    df = spark.createDataFrame([('{"k": NaN}',), ('{"k": Infinity}',), ('{"k": 2.5}',)], "t string")
    out = read_json_text(df, "t", T.StructType([T.StructField("k", T.DoubleType())]))
    assert [r["parsed"]["k"] for r in out.collect()] == [None, None, 2.5]


def test_summary_sink(spark):
    d = tempfile.mkdtemp(prefix="sum-")
    df = spark.createDataFrame([("m", float("nan"))], "model string, score double")
    write_summary(df, os.path.join(d, "out"))
    files = [f for f in os.listdir(os.path.join(d, "out")) if f.startswith("part-")]
    text = open(os.path.join(d, "out", files[0])).read().strip()
    assert text == '{"model":"m"}'


def test_report_and_table_sinks(spark):
    from synthaudit.sources.sinks import write_report, write_table

    d = tempfile.mkdtemp(prefix="sinks-")
    rep = spark.createDataFrame([("a", 0.5, float("nan"))], "model string, score double, x double")
    write_report(rep, os.path.join(d, "report"))
    parts = [f for f in os.listdir(os.path.join(d, "report")) if f.startswith("part-")]
    assert len(parts) == 1                                   # k rows -> one file
    assert open(os.path.join(d, "report", parts[0])).read().splitlines()[0] == "model,score,x"
    big = spark.range(1000).repartition(4)
    write_table(big, os.path.join(d, "tbl"))
    assert spark.read.parquet(os.path.join(d, "tbl")).count() == 1000
    write_table(big, os.path.join(d, "tblcsv"), fmt="csv")
    assert spark.read.option("header", True).csv(os.path.join(d, "tblcsv")).count() == 1000


def _odd_csv(rows: int, seed: int) -> str:
    """Records whose values hold line breaks, doubled quotes, separators and lines that look like records."""
    import random

    rng = random.Random(seed)
    cell = ["plain", '"a,b"', '"said ""hi"""', '"two\nlines"', '"1,2\n3,4\n"', '"\n\n"', '"""\n"', "", '"x\r\ny"', "7", '"é,\n日"']
    return "k,a,b\n" + "".join(f"{i},{rng.choice(cell)},{rng.choice(cell)}\n" for i in range(rows))


def test_line_breaks_inside_quotes_are_read_by_parts(spark, tmp_path):
    from synthaudit.sources.csv import quoted_records, read_text_csv

    for n, end in ((0, "\n"), (1, "")):
        text = _odd_csv(1500, n)
        (tmp_path / f"file{n}.csv").write_bytes((text[:-1] + end).encode())
    (tmp_path / "crlf.csv").write_bytes(b'k,a,b\r\n90001,"x\r\ny",p\r\n90002,q,r\r\n')
    (tmp_path / "head.csv").write_bytes(b'\nk,a,b\n90003,"x\ny",p\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "999")
        records = quoted_records(spark, str(tmp_path))
        assert records.select("__file", "__part").distinct().count() > 40
        parts = read_text_csv(spark, str(tmp_path)).collect()
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        whole = read_text_csv(spark, str(tmp_path), True).collect()
        key = lambda r: (r.k, r.a or "", r.b or "")                   # noqa: E731
        assert sorted(map(key, parts)) == sorted(map(key, whole)) and len(parts) == 3003
        spark.conf.set("spark.sql.files.maxPartitionBytes", "777")
        a = {r.row_key: r.k for r in read_csv(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    b = {r.row_key: r.k for r in read_csv(spark, str(tmp_path)).collect()}
    assert a == b and sorted(a) == list(range(3003))               # dense, and the same on rereading
    order = [a[i] for i in range(3003)]
    assert order == [90001, 90002, *range(1500), *range(1500), 90003]      # files by name, rows in order


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"f{n}.csv").write_text("x\n" + "".join(f"{n * 5000 + i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        df = read_csv(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 10
        assert [tuple(r) for r in df.orderBy("row_key").collect()] == [(i, i) for i in range(15000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)

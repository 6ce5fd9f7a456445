"""CSV source with inference.

The file is read as text (header, RFC-4180 quoting with doubled quotes,
line breaks inside quotes) and always by parts of files:

* a folder in which no line has an odd number of quotes has no line break
  inside a value and is read by Spark's parser, a task per part of a file;
* else one pass counts the quotes of each part.  Their running sum tells for
  each part whether it begins inside a value, so a second pass finds the lines
  at which a record begins and puts records together; pieces of a record that
  goes over the edge of a part (at most two a part) are joined afterwards.

The usual missing-value tokens become NULL.  Column types are then chosen from
one aggregate of ``try_cast`` counts: long, else double, else boolean, else
text.  Dates stay text (so they take part in the cardinality rule; the
datetime probe recognises them).  A ``row_key`` is added when the data has no
key: rows are numbered 0, 1, 2 ... in the order of the files' names and of the
rows in them, by counts of each part, and written once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from synthaudit.functions.shipping import ship_package
from synthaudit.operators.clean import LoaderError
from synthaudit.session import cut_lineage

# Text read as missing (the common CSV reader default set).
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
BOOL_TOKENS = ("true", "false", "True", "False", "TRUE", "FALSE")
CSV_GLOB = "*.[cC][sS][vV]"


#: where a row stands: file, part of the file, place among the part's rows
PLACE = ("__file", "__part", "__row")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return (spark.read.option("pathGlobFilter", CSV_GLOB).option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"),
                    "value", (quotes % 2).cast("int").alias("odd")))


def breaks_inside_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a quoted value may go on in the next line: then some line has
    an odd number of quotes."""
    return not _lines(spark, path).where("odd = 1").isEmpty()


def _records(batches: Iterator[pa.RecordBatch], inside) -> Iterator[pa.RecordBatch]:
    """Records of each part in order.  ``kind``: 0 a whole one, 1 one that
    goes on in the next part, 2 the rest of one that began before."""
    part, row, odd, held, kind = None, 0, False, [], 0

    def close(last: bool):
        # what a part ends with goes on in the next one if a quote is open
        return (*part, row, "\n".join(held), kind if kind == 2 or not (last and odd) else 1)

    for batch in batches:
        out = []
        for file, start, value, q in zip(*(batch.column(c).to_pylist() for c in ("file", "part", "value", "odd"))):
            if (file, start) != part:
                if held:
                    out.append(close(True))
                part, row, held = (file, start), -1, []
                odd = inside.value.get(part, False)
                kind = 2 if odd else 0
            if not odd:
                if held:
                    out.append(close(False))
                held, row, kind = [], row + 1, 0
            held.append(value)
            odd ^= bool(q)
        yield _record_batch(out)
    if held:
        yield _record_batch([close(True)])


_RECORD = "__file string, __part long, __row long, record string, kind int"
_RECORD_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32()]


def _record_batch(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_RECORD_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RECORD_TYPES)],
                                      names=[*PLACE, "record", "kind"])


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files as text (``record``) with their place; values
    may hold line breaks, and no file needs to be read by one task."""
    ship_package(spark)
    lines = _lines(spark, path)
    parts = lines.groupBy("file", "part").agg((F.sum("odd") % 2 == 1).alias("odd")).collect()     # a row a part
    inside, file, odd = {}, None, False
    for p in sorted(parts, key=lambda r: (r["file"], r["part"])):
        odd = False if p["file"] != file else odd
        file, inside[p["file"], p["part"]] = p["file"], odd
        odd ^= p["odd"]
    shared = spark.sparkContext.broadcast(inside)
    rows = cut_lineage(lines.mapInArrow(lambda it: _records(it, shared), _RECORD))
    # pieces over the edges of parts: at most two a part
    by_file = Window.partitionBy("__file").orderBy("__part", F.desc("kind"))
    number = F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(by_file.rowsBetween(Window.unboundedPreceding, 0))
    pieces = rows.where("kind > 0").withColumns({"number": number, "at": F.row_number().over(by_file)})
    joined = pieces.groupBy("__file", "number").agg(
        F.min_by("__part", "at").alias("__part"), F.min_by("__row", "at").alias("__row"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "record"))), lambda x: x["record"]), "\n").alias("record"))
    whole = rows.where("kind = 0").select(*PLACE, "record").unionByName(joined.select(*PLACE, "record"))
    # in files with CR LF ends a line break inside a value is one, too: LF, as the plain parser has it
    text = F.when(F.endswith("record", F.lit("\r")), F.replace(F.rtrim("record", F.lit("\r")), F.lit("\r\n"), F.lit("\n")))
    return whole.withColumn("record", F.coalesce(text, F.col("record"))).where(F.trim("record") != "")


def read_text_csv(spark: SparkSession, path: str, multi_line: bool | None = None, places: bool = False) -> DataFrame:
    """All columns as text, with ``places`` also where each row stands;
    ``multi_line`` None: by parts of files, as the quotes in them require;
    True: Spark's parser for such files, a task a file."""
    try:
        reader = (spark.read.option("header", True).option("escape", '"').option("inferSchema", False)
                  .option("pathGlobFilter", CSV_GLOB))
        if multi_line is None and breaks_inside_quotes(spark, path):
            names = reader.option("multiLine", True).csv(path).columns
            schema = T.StructType([T.StructField(f"c{j}", T.StringType()) for j in range(len(names))])
            records = quoted_records(spark, path)
            first = Window.partitionBy("__file").orderBy("__part", "__row")
            # the header: the first record of each file, which begins in its first part
            top = records.where("__part = 0 AND __row < 64").withColumn("n", F.row_number().over(first)).where("n = 1")
            body = records.join(F.broadcast(top.select("__file", F.col("__row").alias("head"))), "__file", "left").where(
                (F.col("__part") > 0) | F.col("head").isNull() | (F.col("__row") > F.col("head")))
            parsed = body.select(*PLACE, F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "),
                                                    {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}).alias("r"))
            # fewer values than columns: NULL, as in the plain reader
            df = parsed.select(*PLACE, *[F.col(f"r.c{j}").alias(c) for j, c in enumerate(names)])
        else:
            df = reader.option("multiLine", bool(multi_line)).csv(path)
            columns = [F.col(f"`{c}`") for c in df.columns]
            df = df.select(F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.file_block_start").alias(PLACE[1]),
                           F.monotonically_increasing_id().alias(PLACE[2]), *columns)
        return df if places else df.drop(*PLACE)
    except AnalysisException as exc:
        raise LoaderError(f"no readable CSV below {path}: {exc}") from exc


def number_rows(placed: DataFrame, key: str) -> DataFrame:
    """``placed`` (written once) with ``key`` 0, 1, 2 ... in file order, by the
    counts of the files' parts; places inside a part may have gaps at its
    beginning only."""
    placed = cut_lineage(placed)
    rank = F.row_number().over(Window.partitionBy(*PLACE[:2]).orderBy(PLACE[2])) - 1
    parts = placed.groupBy(*PLACE[:2]).agg(F.count("*").alias("n"), F.min(PLACE[2]).alias("low"), F.max(PLACE[2]).alias("high"))
    rows = sorted(parts.collect(), key=lambda r: tuple(r)[:2])                # a row a part
    before, at = [], 0
    for r in rows:
        before.append((r[0], r[1], at, r["low"]))
        at += r["n"]
    offsets = F.broadcast(placed.sparkSession.createDataFrame(before, "__file string, __part long, __before long, __low long"))
    # rows of a part that lack no place are numbered without a sort
    dense = all(r["high"] - r["low"] + 1 == r["n"] for r in rows)
    place = F.col(PLACE[2]) - F.col("__low") if dense else rank
    return placed.join(offsets, list(PLACE[:2])).withColumn(key, F.col("__before") + place).drop(*PLACE, "__before", "__low")


def infer_types(df: DataFrame, skip: tuple = ()) -> dict:
    """Column -> 'bigint' | 'double' | 'boolean' | 'string' from one pass."""
    cols = [c for c in df.columns if c not in skip]
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        aggs += [F.count(x).alias(f"n{i}"),
                 F.count(F.expr(f"try_cast(`{c}` AS BIGINT)")).alias(f"l{i}"),
                 F.count(F.expr(f"try_cast(`{c}` AS DOUBLE)")).alias(f"d{i}"),
                 F.count_if(x.isin(*BOOL_TOKENS)).alias(f"b{i}")]
    if not aggs:
        return {}
    r = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        n = r[f"n{i}"]
        if n == 0:
            out[c] = "string"
        elif r[f"l{i}"] == n:
            out[c] = "bigint"
        elif r[f"d{i}"] == n:
            out[c] = "double"
        elif r[f"b{i}"] == n:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


def read_csv(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Typed DataFrame of a CSV file or folder of CSV files."""
    raw = read_text_csv(spark, path, places=key is None)
    if raw.isEmpty():
        raise LoaderError(f"no data rows in {path}")
    nulled = raw.select(*[F.col(c) if c in PLACE else F.when(F.col(f"`{c}`").isin(*NULL_TOKENS), F.lit(None))
                          .otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    types = infer_types(nulled, PLACE)        # the key, too: text "10" would sort before "2"
    out = []
    for c in nulled.columns:
        t = types.get(c)
        if t in ("bigint", "double"):
            out.append(F.expr(f"try_cast(`{c}` AS {t.upper()})").alias(c))
        elif t == "boolean":
            out.append(F.lower(F.col(f"`{c}`")).cast("boolean").alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    typed = nulled.select(*out)
    return number_rows(typed, "row_key") if key is None else typed

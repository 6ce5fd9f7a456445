"""Helpers shared by the operators: tables in the shared scratch folder,
Arrow text access, and word scanning in numpy over UTF-8 bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from synthaudit.functions.shipping import ship_package
from synthaudit.session import ensure_checkpoint_dir

BLOCK_BYTES = 2 << 20      # text handled at once inside a task (a longer text is a block of its own)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder of ``spark.checkpoint.dir`` and
    read it back: later jobs survive the loss of executors and do not
    repeat the work."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def schema_of(*columns: tuple[str, DataType | str]) -> StructType:
    """A schema from (name, type) pairs; a type is a DataType or its DDL."""
    out = StructType()
    for name, kind in columns:
        out = out.add(name, kind if isinstance(kind, DataType) else StructType.fromDDL(f"x {kind}")[0].dataType)
    return out


def whole_rows(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` as the struct ``doc_id`` beside ``text``: an
    operator that carries ``doc_id`` through then carries the row, whatever
    its other columns are called."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc_id"), "text")


# ------------------------------------------------------------------ Arrow text
def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, end row, bytes, offsets)`` of runs of rows that
    hold about ``block_bytes`` of text."""
    data, off = text_buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + block_bytes, "right")) - 1)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


# ------------------------------------------------------------------ words
def _table(is_member) -> np.ndarray:
    return np.array([bool(is_member(b)) for b in range(256)])


#: white space that ends a word: blank, tab, line feed, vertical tab, form feed, carriage return
SPACE_WORD = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: letters, digits and everything beyond ASCII, once A-Z are lower case
ALNUM_WORD = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def find_words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray):
    """``(starts, ends, row_bounds)``: byte spans of all words, and for each
    row the range of its words (``row_bounds[i]:row_bounds[i + 1]``)."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = member[data]
    edge = np.zeros(n + 1, bool)            # a row begins here
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes (words must not overlap)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    length = ends - starts
    begin = np.repeat(starts, np.diff(np.append(starts, n)))
    at = np.arange(starts[0], n) - begin
    inside = at < np.repeat(length, np.diff(np.append(starts, n)))
    value = (data[starts[0]:].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()))[np.minimum(at, length.max() - 1)]
    value[~inside] = 0
    return mix64(np.add.reduceat(value, starts - starts[0]) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * _BASE + words[k:k + n]
    return mix64(h)


def pack(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpack(blob: bytes | None, dtype, count: int) -> np.ndarray:
    if not count or not blob:
        return np.zeros(0, dtype)
    return np.frombuffer(pa.decompress(blob, decompressed_size=count * np.dtype(dtype).itemsize, codec="zstd",
                                       asbytes=True), dtype)

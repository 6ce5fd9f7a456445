"""Packing: concatenate all documents' token ids and cut the stream into
fixed windows.

Pass 1 tokenises once and stores, per input partition, each document's ids
with its offset inside that partition.  The partition token totals are
prefix-summed (one row per partition), which gives every document its place
in the global stream.  Pass 2 cuts documents at the window boundaries; a
document that crosses one yields a record on either side.  No row moves
between tasks.

Defined cases: a null or empty text is the end id alone; a null ``doc_id``
is carried through; repeated rows are packed once each; an empty table
gives no piece; other columns are ignored.
"""

from __future__ import annotations

import array
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synthaudit.functions.shipping import ship_package
from synthaudit.llm.common import schema_of, scratch_table

CACHE_WORDS = 600_000      # words whose ids a worker remembers; it forgets all when full
_DOUBLE = re.compile(r"\s\s")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


#: fixed value: the published splitting rule of byte-level vocabularies
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level
    vocabulary: itself if printable in Latin-1, else one from 256 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}


def _ranked(path: str):
    """The vocabulary of a ``tokenizers`` file as a ``tiktoken`` encoding, which
    is much quicker for single words; None unless it is certain to agree: a plain
    byte-level BPE with the published splitting rule, whose merges come in the
    order of the ids that they make."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, split = whole["model"], whole.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and not whole.get("normalizer") and split.get("type") == "ByteLevel"
             and split.get("use_regex", True) and not split.get("add_prefix_space") and not model.get("dropout")
             and not model.get("ignore_merges"))
    if not plain:
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    single = sorted(model["vocab"].values())[:256]
    if made != sorted(made) or made[0] <= single[-1] or len(set(made)) != len(made):
        return None
    byte = _byte_characters()
    special = {t["content"] for t in whole.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class WordCachedEncoder:
    """Ids of ``tokenizers`` for whole texts, remembering each distinct word.

    A byte-level vocabulary never merges across a single blank between two
    non-blank characters: the blank belongs to what follows.  A text is cut
    there and each distinct piece is encoded once, by the ranks of the same
    vocabulary where they are certain to agree.  A piece that could hold one of the
    vocabulary's added tokens goes to ``tokenizers`` itself.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ranked = _ranked(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(re.escape(t[:2]) for t in added)) if added else None
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4"
        self.code = "H" if self.dtype == "<u2" else "I"
        self.cache_words = cache_words
        self.first: dict[str, bytes] = {"": b""}
        self.later: dict[str, bytes] = {}

    def _pack(self, ids) -> bytes:
        return array.array(self.code, ids).tobytes()

    def _learn(self, words: set[str]) -> None:
        rest = []
        for w in words:
            if self.ranked is None or self.added and self.added.search(w):
                rest.append(w)
            else:
                self.later[w] = self._pack(self.ranked.encode_ordinary(" " + w))
        for w, e in zip(rest, self.tokenizer.encode_batch_fast([" " + w for w in rest], add_special_tokens=False)):
            self.later[w] = self._pack(e.ids)

    def _head(self, word: str) -> bytes:
        got = self.first.get(word)
        if got is None:
            got = self.first[word] = self._pack(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.first) + len(self.later) > self.cache_words:
            self.first, self.later = {"": b""}, {}
        get, out, unknown = self.later.get, [], set()
        for t in texts:
            words = t.split(" ") if not _DOUBLE.search(t) else _BETWEEN.split(t)
            head = self._head(words[0])
            words = words[1:]
            ids = list(map(get, words))
            if None in ids:
                unknown.update([w for w, i in zip(words, ids) if i is None])
            out.append((head, words, ids))
        self._learn(unknown)
        return [head + b"".join(ids if None not in ids else map(get, words)) for head, words, ids in out]


_ENCODERS: dict[str, WordCachedEncoder] = {}


def encoder_of(path: str) -> WordCachedEncoder:
    """One encoder for all tasks that a Python worker runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordCachedEncoder(path)
    return _ENCODERS[path]


def _token_rows(path: str, end_id: int):
    def run(batches):
        encoder = encoder_of(path)
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(0, batch.num_rows, 256):
                rows = [t or "" for t in texts.slice(i, 256).to_pylist()]
                end = np.array([end_id], encoder.dtype).tobytes()
                blobs = [b + end for b in encoder.encode(rows)]
                n = np.array([len(b) for b in blobs], np.int64) // np.dtype(encoder.dtype).itemsize
                at = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, 256), pa.array(np.full(len(rows), part, np.int32)), pa.array(at), pa.array(n),
                     pa.array(blobs, pa.binary())], names=["doc_id", "part", "at", "doc_tokens", "blob"])
    return run


def _piece_rows(window: int):
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                first = b.column("first").to_numpy(zero_copy_only=False)
                n = b.column("doc_tokens").to_numpy(zero_copy_only=False)
                seq0, seq1 = first // window, (first + n - 1) // window
                count = seq1 - seq0 + 1
                row = np.repeat(np.arange(len(n)), count)
                seq = seq0[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                lo = np.maximum(seq * window, first[row])
                hi = np.minimum((seq + 1) * window, (first + n)[row])
                start = lo - first[row]
                blobs = b.column("blob").to_pylist()
                ids = [np.frombuffer(x, "<u2" if len(x) == 2 * k else "<u4").astype("<u4") for x, k in zip(blobs, n)]
                cut = [ids[r][s:s + k].tobytes() for r, s, k in zip(row, start, hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(hi - lo), pa.array(n[row]),
                     pa.array(seq), pa.array(lo - seq * window), pa.array(cut, pa.binary())], names=names)
    return run


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of ``docs`` (``doc_id``, ``text``): ``doc_id, start, length,
    doc_tokens, sequence_id, offset, ids`` (little-endian unsigned 32-bit)."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        _token_rows(tokenizer, end_id), schema_of(("doc_id", kind), ("part", "int"), ("at", "long"),
                                                  ("doc_tokens", "long"), ("blob", "binary")))
    rows = scratch_table(rows, "tokens")
    totals = rows.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    # one row per input partition of pass 1: the only thing that is prefix-summed in one place
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    placed = rows.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("first"), "doc_tokens", "blob")
    return placed.mapInArrow(_piece_rows(window), schema_of(
        ("doc_id", kind), ("start", "long"), ("length", "long"), ("doc_tokens", "long"), ("sequence_id", "long"),
        ("offset", "long"), ("ids", "binary")))


def sequences(pieces: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """``sequence_id, input_ids`` (exactly ``window`` ids: only the last one is
    padded) and ``segments`` (doc_id, offset, length) of each sequence.  A sequence
    has at most ``window`` pieces, so the group is bounded."""
    def run(batches):
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                flat = b"".join(p["ids"] for p in sorted(parts, key=lambda p: p["offset"]))
                ids = np.full(window, pad_id, np.int32)
                got = np.frombuffer(flat, "<u4")
                ids[:len(got)] = got
                out.append(ids.tolist())
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(out, pa.list_(pa.int32())),
                                              batch.column("segments")], names=["sequence_id", "input_ids", "segments"])

    grouped = pieces.groupBy("sequence_id").agg(
        F.collect_list(F.struct("offset", "ids")).alias("parts"),
        F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id"))).alias("segments"))
    return grouped.mapInArrow(run, schema_of(("sequence_id", "long"), ("input_ids", "array<int>"),
                                             ("segments", grouped.schema["segments"].dataType)))

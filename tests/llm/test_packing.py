import zlib

import numpy as np
import pytest

from synthaudit.llm.packing import WordCachedEncoder, pack_documents, sequences

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b ", "a\n\nb  c.\t d", "don't we're 12,5 x² naïve, é. <|endoftext|> hi<|endoftext|>", " x　y",
       "İstanbul, ß. ﬁ, 한국어, हिन्दी. a,b. ,. . ,", "trail ", "a \n b", "z\x1cy \x85 z"]


def expected(text):
    tok = tokenizers.Tokenizer.from_file(PATH)
    return tok.encode(text or "", add_special_tokens=False).ids + [0]


def test_encoder_equals_tokenizers():
    enc = WordCachedEncoder(PATH, cache_words=5)           # forgets all the time
    for _ in range(2):
        for t in ODD:
            assert np.frombuffer(enc.encode([t])[0], enc.dtype).tolist() == expected(t)[:-1]


def test_pieces_round_trip(make_docs):
    rows = [(i, (t or "") * (40 if i % 3 else 1)) for i, t in enumerate(ODD)] + [(50, None), (None, "x y"), (3, "again")]
    pieces = pack_documents(make_docs(rows, extra=True), PATH, window=64)
    got = [r.asDict() for r in pieces.collect()]
    # the stream has no gap: offsets of a sequence are contiguous and every sequence but the last is full
    by = {}
    for p in got:
        assert p["length"] > 0 and len(p["ids"]) == 4 * p["length"] and p["offset"] + p["length"] <= 64
        by.setdefault(p["sequence_id"], []).append(p)
    assert sorted(by) == list(range(len(by)))
    for s, parts in by.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 64 or s == len(by) - 1
    whole = {}
    for p in sorted(got, key=lambda p: (p["sequence_id"], p["offset"])):
        whole.setdefault((p["doc_id"], p["doc_tokens"]), []).extend(np.frombuffer(p["ids"], "<u4").tolist())
    want = {}
    for i, t in rows:
        want.setdefault((i, len(expected(t))), []).extend(expected(t))
    assert whole == want
    seq = {r.sequence_id: r for r in sequences(pieces, window=64).collect()}
    assert all(len(r.input_ids) == 64 for r in seq.values()) and len(seq) == len(by)
    first = min(by)
    flat = b"".join(p["ids"] for p in sorted(by[first], key=lambda p: p["offset"]))
    assert seq[first].input_ids[:len(flat) // 4] == np.frombuffer(flat, "<u4").tolist()


def test_empty_and_digest(make_docs):
    from synthaudit.llm.queries import packing_digest

    assert pack_documents(make_docs([]), PATH).count() == 0
    row = packing_digest(pack_documents(make_docs([(1, "hello world")]), PATH)).first()
    ids = np.array(expected("hello world"), "<u4").tobytes()
    assert (row.ids_crc32, row.start, row.offset, row.doc_tokens) == (zlib.crc32(ids), 0, 0, 3)

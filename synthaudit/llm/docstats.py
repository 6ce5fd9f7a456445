"""Statistics of whole texts, in numpy over blocks of rows: shares of
character classes, word shapes, and repetition of words, word pairs and lines."""

from __future__ import annotations

import numpy as np

from synthaudit.llm.common import SPACE_WORD, find_words, hash_words, shingle_hashes

FEATURES = ("log_bytes", "log_words", "upper", "lower", "digit", "beyond_ascii", "space", "newline", "comma_stop",
            "exclaim", "bar", "symbol", "other_punct", "word_bytes", "long_words", "short_words", "words_all_upper",
            "words_first_upper", "words_end_symbol", "words_no_letter", "distinct_words", "top_word", "distinct_pairs",
            "adjacent_equal", "distinct_triples", "lines", "words_per_line", "distinct_lines", "stops_per_word",
            "top_line_bytes")


def _is(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


_UPPER, _LOWER, _DIGIT = _is("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _is("abcdefghijklmnopqrstuvwxyz"), _is("0123456789")
_HIGH = np.arange(256) >= 0x80
_NEWLINE, _COMMA, _EXCLAIM, _BAR, _SYMBOL = _is("\n"), _is(",."), _is("!"), _is("|"), _is("#$%&*@^~=+<>{}[]\\/_")
_PUNCT = np.array([0x21 <= b <= 0x7E for b in range(256)]) & ~(_UPPER | _LOWER | _DIGIT | _COMMA | _EXCLAIM | _BAR | _SYMBOL)
_LINE = ~_NEWLINE


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)


def _share(a, b):
    return a / np.maximum(b, 1)


def _repetition(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: number of distinct keys, count of the most frequent one."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    if not len(k):
        return np.zeros(n), np.zeros(n)
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(k)))
    top = np.zeros(n)
    np.maximum.at(top, r[first], count)
    return np.bincount(r[first], minlength=n).astype(np.float64), top


def _runs(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of words that stay inside a row, with their row bounds."""
    h = shingle_hashes(words, width)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = row[:len(h)] == row[width - 1:] if len(h) else np.zeros(0, bool)
    return h[inside], np.concatenate([[0], np.cumsum(np.maximum(0, np.diff(bounds) - width + 1))])


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of :data:`FEATURES` for each text; all finite, also for empty texts."""
    size = np.diff(offsets).astype(np.float64)
    starts, ends, rows = find_words(data, offsets, SPACE_WORD)
    words = hash_words(data, starts, ends)
    n = np.diff(rows).astype(np.float64)
    length = ends - starts
    per_byte = {c: np.concatenate([[0], np.cumsum(t[data], dtype=np.int64)])
                for c, t in (("upper", _UPPER), ("lower", _LOWER), ("high", _HIGH))}
    inside = {c: v[ends] - v[starts] for c, v in per_byte.items()}
    letters = inside["upper"] + inside["lower"] + inside["high"]
    count = {c: (v[offsets[1:]] - v[offsets[:-1]]).astype(np.float64) for c, v in per_byte.items()}
    first = data[starts] if len(starts) else np.zeros(0, np.uint8)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    distinct, top = _repetition(words, rows)
    pairs, pair_rows = _runs(words, rows, 2)
    triples, triple_rows = _runs(words, rows, 3)
    adjacent = np.concatenate([words[1:] == words[:-1], [False]])[:len(words)]
    if len(words):
        adjacent[np.clip(rows[1:] - 1, 0, len(words) - 1)] = False
    line_at, line_end, line_rows = find_words(data, offsets, _LINE)
    lines = hash_words(data, line_at, line_end)
    n_lines = np.diff(line_rows).astype(np.float64)
    line_distinct, _ = _repetition(lines, line_rows)
    widest = np.zeros(len(size))
    np.maximum.at(widest, np.repeat(np.arange(len(size)), np.diff(line_rows)), (line_end - line_at).astype(np.float64))
    out = [np.log1p(size), np.log1p(n), _share(count["upper"], size), _share(count["lower"], size),
           _share(_sums(_DIGIT[data], offsets), size), _share(count["high"], size),
           _share(_sums(~SPACE_WORD[data], offsets), size), _share(_sums(_NEWLINE[data], offsets), size),
           _share(_sums(_COMMA[data], offsets), n), _share(_sums(_EXCLAIM[data], offsets), n),
           _share(_sums(_BAR[data], offsets), n), _share(_sums(_SYMBOL[data], offsets), n),
           _share(_sums(_PUNCT[data], offsets), n), _share(_sums(length, rows), n),
           _share(_sums(length > 12, rows), n), _share(_sums(length < 3, rows), n),
           _share(_sums((inside["upper"] > 1) & (inside["lower"] == 0), rows), n),
           _share(_sums(_UPPER[first], rows), n), _share(_sums(_SYMBOL[last] | _EXCLAIM[last], rows), n),
           _share(_sums(letters == 0, rows), n), _share(distinct, n), _share(top, n),
           _share(_repetition(pairs, pair_rows)[0], np.diff(pair_rows)), _share(_sums(adjacent, rows), n),
           _share(_repetition(triples, triple_rows)[0], np.diff(triple_rows)), np.log1p(n_lines), _share(n, n_lines),
           _share(line_distinct, n_lines), _share(_sums(last == ord("."), rows), n), _share(widest, size)]
    return np.stack(out, axis=1)

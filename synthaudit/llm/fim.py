"""Fill-in-the-middle: a text is cut at two random units and its parts are
put in another order, with an indexable skip list to find the cuts.

The bottom lane of the list is the text itself.  The lane above has a node at
every 1,024th byte, and every 16th node of a lane is promoted to the next
one; each link carries how many units begin under it (unit-width), how many
code points (code-point-width) and its bytes.  A cut of rank r is reached from
the top lane: go right while the units passed do not exceed r, else down,
summing the widths; the last step reads the one stretch of text that is left.
The sums at the end are the rank, the place in code points and the place in
bytes of the cut, exact for texts in any script.  The widths of a block of
texts come from one vectorised pass; no index of single units is ever kept.

Units are code points, words (a word and the white space after it; white
space before the first word is a unit) or lines (with their line feed).

Which rows are rearranged, where they are cut and in which order follows from
``sha256(seed:doc_id)``, so neither partitions nor lost executors change it.
A text that is empty or contains a sentinel stays as it is ("plain"), so
``restore`` always gives back the exact text.

Defined cases: a null text is empty; a null id is hashed as an empty one;
rows that repeat an id are cut by the same draw; an empty table gives no row;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthaudit.functions.shipping import ship_package
from synthaudit.llm.common import SPACE_WORD, schema_of, text_blocks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
STRETCH = 1024                 # bytes of text under a link of the lowest express lane
FAN_OUT = 16                   # links of a lane under one link of the next


# ------------------------------------------------------------------ units
def _code_points(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def _words(data: np.ndarray) -> np.ndarray:
    inside = SPACE_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    return begins


def _lines(data: np.ndarray) -> np.ndarray:
    begins = np.ones(len(data), bool)
    begins[1:] = data[:-1] == 0x0A
    return begins


#: for each unit, whether one begins at each byte (the first byte of a text always begins one)
UNITS = {"codepoint": _code_points, "word": _words, "line": _lines}


# ------------------------------------------------------------------ skip list
class SkipList:
    """The express lanes over one text.  ``links`` is the lowest one: a row
    (units, code points, bytes) for every ``STRETCH`` bytes."""

    def __init__(self, links: np.ndarray):
        self.lanes = [links]
        while len(self.lanes[-1]) > FAN_OUT:
            low = self.lanes[-1]
            self.lanes.append(np.add.reduceat(low, np.arange(0, len(low), FAN_OUT), axis=0))

    def units(self) -> int:
        return int(self.lanes[-1][:, 0].sum())

    def descend(self, rank: int) -> tuple[int, int, int]:
        """(units, code points, bytes) before the stretch that holds unit ``rank``."""
        units = points = size = node = 0
        for lane in reversed(self.lanes):
            node = FAN_OUT * node if lane is not self.lanes[-1] else 0
            for width, chars, length in lane[node:node + FAN_OUT].tolist():
                if units + width > rank:
                    break
                units, points, size, node = units + width, points + chars, size + length, node + 1
        return units, points, size

    def cut(self, rank: int, begins: np.ndarray, leads: np.ndarray) -> tuple[int, int]:
        """(code points, bytes) of the text before unit ``rank``; ``begins``
        and ``leads`` say where the text's units and code points begin."""
        units, points, size = self.descend(rank)
        inside = np.flatnonzero(begins[size:size + STRETCH])
        if rank - units < len(inside):
            step = int(inside[rank - units])
            points += int(np.count_nonzero(leads[size:size + step]))
            size += step
        return points, size


def lowest_lanes(begins: np.ndarray, leads: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of all texts of a block, and where each text's links begin."""
    count = -(-np.diff(offsets) // STRETCH)
    bounds = np.concatenate([[0], np.cumsum(count)])
    if not bounds[-1]:
        return np.zeros((0, 3), np.int64), bounds
    at = np.repeat(offsets[:-1] - bounds[:-1] * STRETCH, count) + np.arange(bounds[-1]) * STRETCH
    widths = [np.add.reduceat(m.view(np.uint8), at, dtype=np.int64) for m in (begins, leads)]
    return np.stack([*widths, np.diff(np.append(at, len(begins)))], axis=1), bounds


# ------------------------------------------------------------------ tasks
def _rearrange(batches: Iterator[pa.RecordBatch], unit: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, forms = batch.column("doc_id"), batch.column("form").to_pylist()
        draws = np.stack([batch.column(c).to_numpy() for c in ("h1", "h2")], axis=1)
        for i, j, data, offsets in text_blocks(batch.column("text")):
            begins, leads = UNITS[unit](data), _code_points(data)
            begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
            links, bounds = lowest_lanes(begins, leads, offsets)
            raw = data.tobytes()
            n, before, middle, out = [], [], [], []
            for r in range(j - i):
                a, b = int(offsets[r]), int(offsets[r + 1])
                lanes = SkipList(links[bounds[r]:bounds[r + 1]])
                n.append(lanes.units())
                if forms[i + r] == "plain":
                    before.append(None)
                    middle.append(None)
                    out.append(raw[a:b])
                    continue
                ranks = np.sort(draws[i + r] % (n[-1] + 1)).tolist()
                (p1, x1), (p2, x2) = (lanes.cut(k, begins[a:b], leads[a:b]) for k in ranks)
                before.append(p1)
                middle.append(p2 - p1)
                first, second, third = raw[a:a + x1], raw[a + x1:a + x2], raw[a + x2:b]
                out.append(b"<P>" + first + b"<S>" + third + b"<M>" + second if forms[i + r] == "psm"
                           else b"<S>" + third + b"<P>" + first + b"<M>" + second)
            columns = [ids.slice(i, j - i), n, forms[i:j], before, middle, out]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type)
                                              for c, f in zip(columns, schema)], schema=schema)


def _draw(seed: int, group: int) -> Column:
    """The ``group``-th eight hex digits of sha256(seed:doc_id) as a number."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 1 + 8 * group, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm_rate: int = 20, unit: str = "codepoint") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n`` (units), ``form``
    (``plain``, ``psm``, ``spm``), ``prefix_chars``, ``middle_chars`` (code
    points; null if plain) and ``output``.  ``rate`` percent of the texts are
    rearranged, ``spm_rate`` percent of these with the suffix first."""
    spark = docs.sparkSession
    ship_package(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = ((text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
             | (_draw(seed, 2) % 100 >= rate))
    form = F.when(plain, "plain").when(_draw(seed, 3) % 100 < spm_rate, "spm").otherwise("psm")
    rows = docs.select("doc_id", "text", form.alias("form"), _draw(seed, 0).alias("h1"), _draw(seed, 1).alias("h2"))
    kind = docs.schema["doc_id"].dataType
    out = schema_of(("doc_id", kind), ("n", "long"), ("form", "string"), ("prefix_chars", "long"),
                    ("middle_chars", "long"), ("output", "string"))
    from pyspark.sql.pandas.types import to_arrow_schema

    return rows.mapInArrow(partial(_rearrange, unit=unit, schema=to_arrow_schema(out)), out)


def restore(output: Column, form: Column) -> Column:
    """The exact text, from ``output`` and ``form`` alone."""
    def between(a: str, b: str) -> Column:
        start = F.locate(a, output) + len(a)
        return F.substr(output, start, F.locate(b, output) - start)

    middle = F.substr(output, F.locate(MIDDLE, output) + len(MIDDLE))
    return (F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
            .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
            .otherwise(output))

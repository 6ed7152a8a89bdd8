"""Splitting oversized items at natural boundaries (problem 5).

Cut places are chosen by dynamic programming over the text's own boundaries.
The cost of a division is the sum of its cuts' penalties, by kind of boundary,
and of the squared deviation of each piece from the even size.  A piece starts
``overlap`` characters before the end of the piece before it.

Boundaries of a finer kind are looked for only where two neighbouring coarser
ones lie further apart than a piece can reach; without that a division into
coarser boundaries always exists, and a finer cut would only cost more.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Size limit and overlap in characters.
LIMIT, OVERLAP = 1200, 120

_BREAK = r"(?:\r\n|[\n\r\u2028\u2029\x85])"
#: A run of breaks is tried at its first one only.
_FIRST = r"(?<![\n\r])"
#: Kinds of boundary from the best to the worst, each with the penalty of a cut there.
#: A match ends where the next piece's new text would start.
KINDS = (
    ("paragraph", 0.0, re.compile(rf"{_BREAK}[ \t]*{_BREAK}\s*")),
    ("heading", 0.05, re.compile(rf"{_FIRST}{_BREAK}+(?=#{{1,6}} )")),
    ("list item", 0.3, re.compile(rf"{_FIRST}{_BREAK}+(?=[ \t]*(?:[-*+•·]|\d+[.)])\s)")),
    ("table row", 0.35, re.compile(rf"{_FIRST}{_BREAK}+(?=\|)|(?<=\|){_BREAK}+")),
    ("line", 0.4, re.compile(rf"{_FIRST}{_BREAK}+")),
    ("sentence", 0.6, re.compile(r"(?<![.!?…])[.!?…]+[\"'”’)\]]*\s+|[。！？]+[」』”’）]*\s*")),
)
_WORD = ("word", 2.0, re.compile(r"\s+|(?<=[,;:，、；：/])"))
_HARD = ("none", 6.0)
#: Hard cuts are offered every so many characters of a stretch without any boundary.
_STEP = 24


def _stretch(marks: dict[int, float], length: int, reach: int) -> list[tuple[int, int]]:
    """Neighbouring boundaries that lie further apart than a piece reaches."""
    at = [0, *sorted(marks), length]
    return [(a, b) for a, b in zip(at, at[1:], strict=False) if b - a > reach]


def boundaries(text: str, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where the text may be cut, in order, and their penalties; the last place is its end."""
    marks: dict[int, float] = {}
    for _, penalty, pattern in KINDS:
        for m in pattern.finditer(text):
            if 0 < m.end() < len(text):
                marks.setdefault(m.end(), penalty)
    for a, b in _stretch(marks, len(text), reach):
        for m in _WORD[2].finditer(text, a, b):
            if a < m.end() < b:
                marks.setdefault(m.end(), _WORD[1])
    for a, b in _stretch(marks, len(text), reach):
        for place in range(a + min(_STEP, reach), b, min(_STEP, reach)):
            if text[place - 1] == "\r" and text[place] == "\n" and reach > 1:
                place -= 1  # a line end stays whole
            if place > a:
                marks.setdefault(place, _HARD[1])
    places = sorted(marks)
    return np.array([*places, len(text)]), np.array([*(marks[p] for p in places), 0.0])


def cut_places(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Ends of the pieces of a text, the last being its length.

    The first piece has at most ``limit`` characters of new text, each later
    one at most ``limit - overlap``.  A text within the limit is one piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    n = len(text)
    if n <= limit:
        return [n]
    reach = limit - overlap
    at, penalty = boundaries(text, reach)
    pieces = math.ceil((n - overlap) / reach)
    even = (n - overlap) / pieces
    cost = np.full(len(at), np.inf)
    back = np.full(len(at), -1)
    start = np.searchsorted(at, at - reach)
    for j in range(len(at)):
        end = at[j]
        if end <= limit:  # the first piece
            cost[j] = penalty[j] + ((end - overlap - even) / even) ** 2
        i = start[j]
        if i < j and end > reach:
            way = cost[i:j] + ((end - at[i:j] - even) / even) ** 2
            k = int(way.argmin())
            if way[k] + penalty[j] < cost[j]:
                cost[j] = way[k] + penalty[j]
                back[j] = i + k
    ends, j = [], len(at) - 1
    while j >= 0:
        ends.append(int(at[j]))
        j = back[j]
    return ends[::-1]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(start, piece) of a text; a later piece begins with the last ``overlap`` characters before it."""
    ends = cut_places(text, limit, overlap)
    starts = [0, *(max(0, e - overlap) for e in ends[:-1])]
    return [(a, text[a:b]) for a, b in zip(starts, ends, strict=True)]


def split_oversized(
    df: DataFrame, column: str = "content", limit: int = LIMIT, overlap: int = OVERLAP
) -> DataFrame:
    """Every row as one or more pieces: the other columns, then piece_no, n_pieces, piece_start, piece.

    Rows whose text is null or within the limit pass as they are, one piece,
    without leaving the JVM.  Repeated rows are split each.  Piece columns
    that ``df`` already has are replaced; other columns are carried along, so
    a heading goes with each piece.
    """
    made = ("piece_no", "n_pieces", "piece_start", "piece")
    df = df.drop(*[c for c in made if c != column])
    others = [c for c in df.columns if c != column]
    long = F.length(column) > limit
    within = df.where(~F.coalesce(long, F.lit(False))).select(
        *others, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("piece_start"),
        F.col(column).alias("piece"),
    )
    schema = StructType(
        [
            *[df.schema[c] for c in others],
            *[StructField(c, IntegerType()) for c in made[:3]],
            StructField("piece", StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, total, start, piece = [], [], [], [], []
            for i, text in enumerate(batch.column(len(others)).to_pylist()):
                parts = split_text(text, limit, overlap)
                row += [i] * len(parts)
                number += range(len(parts))
                total += [len(parts)] * len(parts)
                start += [a for a, _ in parts]
                piece += [p for _, p in parts]
            taken = batch.take(pa.array(row, pa.int64()))
            new = [pa.array(x, pa.int32()) for x in (number, total, start)]
            yield pa.RecordBatch.from_arrays(
                [*taken.columns[: len(others)], *new, pa.array(piece, pa.string())], names=schema.names
            )

    cut = df.where(long).select(*others, column).mapInArrow(run, schema)
    return within.unionByName(cut)

"""Splitting oversized items at natural boundaries.

Method: agglomerative merging. An item begins as atomic segments, the stretches of words without a
natural place to cut. Adjacent pairs wait in a heap, the weakest boundary first, and are merged
while the joined size plus the overlap fits the limit. What remains are the pieces; each but the
first also repeats about `overlap` words of the one before, from a natural place where there is one.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"\S+")
_LINE_BREAK = re.compile("[\n\r\v\f\x85  ]")
_BLANK_LINE = re.compile(r"(\r\n|\n|\r|\f)[^\S\n\r\f]*(\r\n|\n|\r|\f)")

#: Strengths of the boundary after a word, from none to the end of a paragraph.
NONE, CLAUSE, SENTENCE, LINE, PARAGRAPH = 0, 1, 2, 3, 4

PIECE_FIELDS = [
    T.StructField("piece_no", T.IntegerType()),
    T.StructField("n_words", T.IntegerType()),
    T.StructField("repeated", T.IntegerType()),
    T.StructField("start_char", T.IntegerType()),
    T.StructField("end_char", T.IntegerType()),
    T.StructField("forced", T.BooleanType()),
    T.StructField("text", T.StringType()),
]


def boundaries(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Spans of the words of a text, and the strength of the boundary after each of them."""
    spans = [m.span() for m in _WORD.finditer(text)]
    strengths = []
    for (start, end), following in zip(spans, [*(s for s, _ in spans[1:]), len(text)]):
        gap, word = text[end:following], text[start:end]
        if _BLANK_LINE.search(gap):
            strengths.append(PARAGRAPH)
        elif _LINE_BREAK.search(gap):
            strengths.append(LINE)
        elif any(c in word for c in ".!?"):
            strengths.append(SENTENCE if word.rstrip("\"'”’)»")[-1:] in (".", "!", "?") else CLAUSE)
        else:
            strengths.append(CLAUSE if ";" in word else NONE)
    return spans, strengths


def merged(strengths: list[int], limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """Pieces of an item as (first word, end word, cut by force), without what they repeat."""
    n, room = len(strengths), limit - overlap
    starts, forced = [], []
    at = 0
    for i in range(n):
        if strengths[i] > NONE or i == n - 1:
            size = i + 1 - at
            if size > limit:
                parts = -(-size // room)
                starts += [at + size * k // parts for k in range(parts)]
                forced += [True] * parts
            else:
                starts.append(at)
                forced.append(False)
            at = i + 1
    m = len(starts)
    ends = [*starts[1:], n]
    left, right, alive, version = list(range(-1, m - 1)), list(range(1, m + 1)), [True] * m, [0] * m

    def fits(a: int, b: int) -> bool:
        size = ends[b] - starts[a]
        return size + (overlap if starts[a] else 0) <= limit

    heap = []

    def offer(a: int) -> None:
        b = right[a]
        if b < m and fits(a, b):
            heapq.heappush(heap, (strengths[ends[a] - 1], ends[b] - starts[a], starts[a], a, version[a], b, version[b]))

    for a in range(m - 1):
        offer(a)
    while heap:
        *_, a, va, b, vb = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or version[a] != va or version[b] != vb:
            continue
        ends[a], forced[a], alive[b] = ends[b], forced[a] or forced[b], False
        right[a] = right[b]
        if right[b] < m:
            left[right[b]] = a
        version[a] += 1
        offer(a)
        if left[a] >= 0:
            offer(left[a])
    return [(starts[i], ends[i], forced[i]) for i in range(m) if alive[i]]


def pieces_of(text: str | None, limit: int, overlap: int) -> list[tuple]:
    """All pieces of one text: (number, words, repeated words, start, end, forced, text)."""
    spans, strengths = boundaries(text or "")
    if not spans:
        return []
    if len(spans) <= limit:
        return [(0, len(spans), 0, 0, len(text), False, text)]
    out = []
    for k, (first, end, forced) in enumerate(merged(strengths, limit, overlap)):
        begin = first
        if k:
            most = min(overlap, limit - (end - first), first)
            near = range(max(first - most, 1), first - (6 * most) // 10 + 1)
            begin = max(near, key=lambda i: (strengths[i - 1], -i), default=first - most) if most else first
            if most and strengths[begin - 1] == NONE:
                begin = first - most
        a, b = spans[begin][0], spans[end - 1][1]
        out.append((k, end - begin, first - begin, a, b, forced, text[a:b]))
    return out


def split_oversized(
    items: DataFrame, keys: list[str], text_col: str, limit: int = 400, overlap: int = 40, oversized_only: bool = False
) -> DataFrame:
    """Pieces of at most `limit` words of every item; a word is a run without whitespace.

    Columns: the keys, piece_no (from 0), n_words, repeated (words shared with the piece before),
    start_char and end_char (offsets in the item, end exclusive), forced (a stretch of more than
    `limit` words had no natural place to cut) and text. An item within the limit is one piece,
    its whole text. Null, empty and blank texts have no pieces. Repeated rows give their pieces
    again. Other columns are not looked at, so they may have any name.

    Natural places are line breaks and any of . ! ? ; between words. A stretch of up to `limit`
    words without one stays whole, if need be with a shorter overlap.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    rows = items.select(*keys, F.col(text_col).alias("__text"))
    if oversized_only:
        # limit + 1 words need as many characters and a space between each two
        rows = rows.where(F.length("__text") > 2 * limit)
    schema = T.StructType([*rows.schema.fields[:-1], *PIECE_FIELDS])
    kinds = [pa.int32()] * 5 + [pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                found = pieces_of(text, limit, overlap)
                if not (oversized_only and len(found) < 2):
                    out += [(i, *p) for p in found]
            at = pa.array([r[0] for r in out], pa.int64())
            columns = [pa.array([r[j + 1] for r in out], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), *columns], [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)

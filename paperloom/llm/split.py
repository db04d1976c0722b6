"""Splitting of oversized texts at natural boundaries, by agglomerative merging.

A text above the limit is cut into atoms: sentences, or words and at last characters where a
sentence alone is too long. Adjacent atoms are held in a heap by the strength of the boundary
between them; the weakest boundary is merged first, as long as the merged piece and the overlap
it will carry stay within the limit. What remains are pieces that end at the strongest boundaries
that can be kept. Each piece after the first begins with the last ``overlap`` characters of the
one before, or with fewer where a natural end lies within these.

Defined results: null, empty and blank texts and texts up to the limit come out as one piece as
they are (none for null); repeated rows are split once each by key, so exact copies of a row give
the pieces once; concatenating the new parts of the pieces gives the text back; extra columns are
ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 6000, 300
CHARACTER, WORD, SENTENCE, LINE, PARAGRAPH = range(5)
_ENDS = re.compile(r"[\n\r\v\f\x85\u2028\u2029]\s*|[.!?…][\"'”’)\]]*\s+|[。！？]+\s*")
_BLANKS = re.compile(r"\s+")
_BREAKS = re.compile(r"\r\n|[\n\r\v\f\x85\u2028\u2029]")


def boundaries(text: str) -> list[tuple[int, int]]:
    """(position, strength) of paragraph, line and sentence ends; a piece may end at each position."""
    out = []
    for m in _ENDS.finditer(text):
        got = m.group()
        breaks = 0 if got[-1] == " " and len(got) == 2 else len(_BREAKS.findall(got))
        out.append((m.end(), PARAGRAPH if breaks > 1 or "\f" in got else LINE if breaks else SENTENCE))
    return out


def atoms(text: str, room: int, marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(end, strength of the boundary there) of atoms of at most ``room`` characters."""
    out, start = [], 0
    for end, strength in [*marks, (len(text), PARAGRAPH)]:
        if end <= start:
            continue
        if end - start > room:
            at = start
            for m in _BLANKS.finditer(text, start, end):
                while m.end() - at > room:
                    at += room
                    out.append((at, CHARACTER))
                if at < m.end() < end:
                    at = m.end()
                    out.append((at, WORD))
            while end - at > room:
                at += room
                out.append((at, CHARACTER))
        out.append((end, strength))
        start = end
    return out


def merge(ends: list[tuple[int, int]], limit: int, overlap: int) -> list[int]:
    """Ends of the pieces after merging the weakest boundaries first."""
    n = len(ends)
    start = [0, *(e for e, _ in ends[:-1])]
    stop = [e for e, _ in ends]
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    # equal boundaries: the smaller merged piece first, then from the front
    heap = [(ends[i][1], stop[i + 1] - start[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        strength, size, a, b = heapq.heappop(heap)
        if not alive[a] or right[a] != b or stop[b] - start[a] != size:
            continue
        if size + (overlap if start[a] else 0) > limit:
            continue
        alive[b] = False
        stop[a], right[a] = stop[b], right[b]
        if right[b] >= 0:
            left[right[b]] = a
            heapq.heappush(heap, (ends_strength(ends, stop[a]), stop[right[b]] - start[a], a, right[b]))
        if left[a] >= 0:
            c = left[a]
            heapq.heappush(heap, (ends_strength(ends, stop[c]), stop[a] - start[c], c, a))
    return [stop[i] for i in range(n) if alive[i]]


def ends_strength(ends: list[tuple[int, int]], position: int) -> int:
    """Strength of the boundary at the end of a piece."""
    lo, hi = 0, len(ends)
    while lo < hi:
        mid = (lo + hi) // 2
        if ends[mid][0] < position:
            lo = mid + 1
        else:
            hi = mid
    return ends[lo][1]


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, new_from, end) of each piece: text[start:end], of which text[start:new_from] repeats the piece before."""
    if len(text) <= limit:
        return [(0, 0, len(text))]
    marks = boundaries(text)
    cuts = merge(atoms(text, limit - overlap, marks), limit, overlap)
    natural = [e for e, _ in marks]
    out, before, begun = [], 0, 0
    at = 0
    for cut in cuts:
        start = before
        if before:
            start = max(before - overlap, begun)
            while at < len(natural) and natural[at] < start:
                at += 1
            k = at
            if k < len(natural) and natural[k] < before:
                start = natural[k]
            elif start and not text[start - 1].isspace():
                blank = _BLANKS.search(text, start, before)
                if blank and blank.end() < before:
                    start = blank.end()
        out.append((start, before, cut))
        begun, before = start, cut
    return out


def pieces(items: DataFrame, text: str, key: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, n_pieces, start_at, new_from, end_at, piece): the ordered pieces of each text.

    Texts within the limit stay in the JVM; only longer ones go through the merging."""
    rows = items.select(*key, F.col(text).alias("_text")).filter(F.col("_text").isNotNull()).distinct() if key else items
    shape = [F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_at"), F.lit(0).alias("new_from"), F.length("_text").alias("end_at"), F.col("_text").alias("piece")]
    short = rows.filter(F.length("_text") <= limit).select(*key, *shape)
    n = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, cols = [], [[] for _ in range(6)]
            for i, t in enumerate(b.column(n).to_pylist()):
                cut = split(t, limit, overlap)
                for no, (start, new, end) in enumerate(cut, 1):
                    row.append(i)
                    for c, v in zip(cols, (no, len(cut), start, new, end, t[start:end]), strict=True):
                        c.append(v)
            take = pa.array(row, pa.int64())
            keys = [b.column(i).take(take) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, pa.int32()) for c in cols[:5]), pa.array(cols[5], pa.string())], names=[*key, "piece_no", "n_pieces", "start_at", "new_from", "end_at", "piece"])

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in key] + ["piece_no int, n_pieces int, start_at int, new_from int, end_at int, piece string"])
    return short.unionByName(rows.filter(F.length("_text") > limit).mapInArrow(run, schema))


def oversized(items: DataFrame, text: str, key: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_pieces) of the texts that came out in more than one piece; the pieces' texts stay in the worker."""
    rows = items.select(*key, F.col(text).alias("_text")).filter(F.length("_text") > limit)
    n = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [len(split(t, limit, overlap)) for t in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(counts, pa.int32())], names=[*key, "n_pieces"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in key] + ["n_pieces int"])).filter(F.col("n_pieces") > 1).distinct()

"""Splitting oversized items at natural boundaries by agglomerative merging.

A text longer than the limit is cut into atomic segments (sentences, list items, paragraphs; an
atom that is itself too long is cut at clauses, then at blanks, then at a fixed length).  Adjacent
segments are then merged, weakest boundary first and smaller unions first among equals, as long as
the union plus the overlap fits; a heap holds the adjacent pairs.  What remains are the pieces; each
piece but the first is prefixed by the last ``overlap`` characters of the piece before it, so

    text == piece[0] + piece[1][overlap:] + piece[2][overlap:] + ...

Sizes are Unicode code points.  Defined results for odd input: null texts and texts within the limit
give no pieces; a text without any boundary is cut at the fixed length; ties are broken by position;
repeated rows give repeated pieces; texts of any length are handled whole.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4000
OVERLAP = 200

# Strength of the boundary in front of a segment: merged in ascending order.
HARD, BLANK, CLAUSE, SENTENCE, ITEM, PARAGRAPH = range(6)
NAMES = ["hard", "blank", "clause", "sentence", "item", "paragraph"]

_LIST_HEAD = r"(?:[-*•・○]|[(（][^()（）\s]{1,4}[)）]|\d{1,3}(?:[.)．、]|\s*　)|[０-９]{1,3}[．　、]|第\d+[条項号]|[一二三四五六七八九十]{1,3}[　、])"
_BOUNDARY = re.compile(
    r"(?P<paragraph>(?:\r\n|\n|\r)[ \t　]*(?:\r\n|\n|\r)\s*)"
    r"|(?P<item>(?:\r\n|\n|\r)[ \t　]*(?=" + _LIST_HEAD + r"))"
    r"|(?P<line>(?:\r\n|\n|\r))"
    r"|(?P<sentence>(?:[.!?][\"'”’)\]]*[ \t\xa0　]+(?=[\"'“‘(\[]?[^\W\d_a-z])|[。！？｡][」』）)]*))"
)
_CLAUSE = re.compile(r"[,;:、，；：]\s*|[.]\s+")
_BLANK = re.compile(r"\s+")


def _atoms(text: str, most: int) -> list[tuple[int, int]]:
    """(start, strength of the boundary before it) of the atomic segments, in order."""
    cuts = [(0, PARAGRAPH)]
    for m in _BOUNDARY.finditer(text):
        end = m.end()
        if end >= len(text):
            break
        kind = m.lastgroup
        strength = {"paragraph": PARAGRAPH, "item": ITEM, "line": ITEM, "sentence": SENTENCE}[kind]
        if kind == "sentence" and text[end : end + 1] in "\r\n":
            continue  # the line break that follows is the stronger boundary
        if cuts[-1][0] == end:
            cuts[-1] = (end, max(strength, cuts[-1][1]))
        else:
            cuts.append((end, strength))
    bounds = [c[0] for c in cuts] + [len(text)]
    if all(bounds[i + 1] - bounds[i] <= most for i in range(len(cuts))):
        return cuts
    fine: list[tuple[int, int]] = []
    for i, (start, strength) in enumerate(cuts):
        fine.append((start, strength))
        if bounds[i + 1] - start > most:
            fine.extend(_inside(text, start, bounds[i + 1], most))
    return fine


def _inside(text: str, start: int, end: int, most: int) -> list[tuple[int, int]]:
    """Cuts inside one segment that is longer than ``most``: clauses, else blanks, else fixed length."""
    out, at = [], start
    places = {m.end(): BLANK for m in _BLANK.finditer(text, start, end)}
    places |= {m.end(): CLAUSE for m in _CLAUSE.finditer(text, start, end)}
    here = sorted(p for p in places if start < p < end)
    last = start
    for p in [*here, end]:
        while p - at > most:
            if last > at:
                at = last
                out.append((at, places[at]))
            else:
                at += most
                out.append((at, HARD))
        last = p
    return out


def split_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, boundary strength) of every piece's own part; the whole text if it fits the limit."""
    if len(text) <= limit:
        return [(0, PARAGRAPH)]
    room = limit - overlap
    if room <= 0 or overlap < 0:
        raise ValueError("the overlap must be smaller than the limit")
    atoms = _atoms(text, room)
    n = len(atoms)
    start = [a[0] for a in atoms]
    end = [*start[1:], len(text)]
    left, right = [i - 1 for i in range(n)], [i + 1 for i in range(n)]
    alive, stamp = [True] * n, [0] * n

    def union(i: int, j: int) -> int:
        return end[j] - start[i]

    heap = [(atoms[j][1], union(j - 1, j), j, 0, 0) for j in range(1, n)]
    heapq.heapify(heap)
    while heap:
        strength, size, j, sj, si = heapq.heappop(heap)
        if not alive[j] or stamp[j] != sj:
            continue
        i = left[j]
        # an entry pushed for a former neighbour may carry the stamp of the present one by chance, but not its size
        if stamp[i] != si or size != union(i, j):
            continue
        if size > (limit if start[i] == 0 else room):
            continue  # it only grows: this pair can never merge
        end[i], alive[j] = end[j], False
        right[i] = right[j]
        stamp[i] += 1
        if right[i] < n:
            k = right[i]
            left[k] = i
            heapq.heappush(heap, (atoms[k][1], union(i, k), k, stamp[k], stamp[i]))
        if left[i] >= 0:
            heapq.heappush(heap, (atoms[i][1], union(left[i], i), i, stamp[i], stamp[left[i]]))
    return [(start[i], atoms[i][1]) for i in range(n) if alive[i]]


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str, str]]:
    """(piece with its overlap, name of the boundary it starts at), in order."""
    points = split_points(text, limit, overlap)
    ends = [p[0] for p in points[1:]] + [len(text)]
    return [(text[max(0, s - overlap if k else s) : e], NAMES[b]) for k, ((s, b), e) in enumerate(zip(points, ends))]


def split_items(items: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece_no, n_pieces, boundary, piece) of every item longer than ``limit`` characters."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one text at a time: a batch of very long texts is not expanded at once
            for key, text in zip(batch.column(0), batch.column(1)):
                cut = pieces_of(text.as_py(), limit, overlap)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": [key.as_py()] * len(cut),
                        "piece_no": pa.array(range(len(cut)), pa.int32()),
                        "n_pieces": pa.array([len(cut)] * len(cut), pa.int32()),
                        "boundary": [c[1] for c in cut],
                        "piece": [c[0] for c in cut],
                    },
                    schema=pa.schema(
                        [
                            ("id", pa.string()),
                            ("piece_no", pa.int32()),
                            ("n_pieces", pa.int32()),
                            ("boundary", pa.string()),
                            ("piece", pa.string()),
                        ]
                    ),
                )

    long = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(
        F.char_length("text") > limit
    )
    out = long.mapInArrow(run, "id string, piece_no int, n_pieces int, boundary string, piece string")
    return out.withColumnRenamed("id", id_col)

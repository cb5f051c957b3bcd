"""Cutting oversized texts at natural boundaries, by agglomerative merging.

A text is first cut into atomic segments at every blank run, and after every mark of MARKS that stands without a blank (as
in tables and lists written close together, but never inside a number); each boundary has a strength (see STRENGTHS). All adjacent
pairs stand in a heap, the weakest boundary first, of equal ones the pair with the smaller sum; pairs are merged while
their sum, with the overlap if they do not start the text, fits the limit. What cannot be merged any more is a piece.

Defined cases
- Sizes are code points. A piece repeats the last ``overlap`` characters before it; pieces without these repeats joined
  give the text. A segment without any boundary is cut between grapheme clusters, inside one only if it alone is too big.
- Null and empty texts give no piece, texts within the limit one. Repeated rows are cut alike. Blanks stay with the
  piece before them.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Strength of a boundary by what stands before and after a blank run; the first that matches counts.
STRENGTHS = [
    (9, r"\n\s*$", r"제\s?\d+\s?조|Article\s+\d+"),  # article
    (8, r"\n\s*$", r"【|\[|제\s?\d+\s?(?:편|장|절|관)"),  # heading
    (8, r"\n\s*\n\s*$", r""),  # blank line
    (7, r"\n\s*$", r"[①-⑳]|\(\d+\)"),  # paragraph
    (6, r"\n\s*$", r"\d+(?:의\d+)?\.\s"),  # item
    (5, r"\n\s*$", r"[가-하a-z]\.\s"),  # sub-item
    (4, r"\n\s*$", r""),  # line
    (3, r"[.?!。]['\"”’)\]]*\s+$", r"(?!\d)"),  # sentence
    (2, r"[,;:、，]\s+$", r""),  # clause
    (1, r"", r""),  # word
]
# Strength of a mark that no blank follows, by what it is and stands between.
MARKS = [
    (3, r"[。？！]|(?<=[가-힣])[.?!](?=[\p{L}①-⑳\"'“‘(])"),  # sentence
    (2, r"[|｜]|(?<!\d)[,;]|[,;](?!\d)|[、，；]"),  # cell, clause
]
_MARKS = regex.compile("(?:" + "|".join(f"(?P<s{s}>{marks})" for s, marks in MARKS) + r")(?![\s|｜])")
_RULES = [(s, regex.compile(f"(?:{before})") if before else None, regex.compile(after) if after else None) for s, before, after in STRENGTHS]
_BLANKS = regex.compile(r"\s+")
_CLUSTERS = regex.compile(r"\X")

PIECES = "array<struct<piece_no:int,start:int,stop:int,piece:string>>"


def boundaries(text: str) -> list[tuple[int, int]]:
    """(position, strength) of every blank run and mark inside ``text``, in order; the position is that after it."""
    found = [(at, int(m.lastgroup[1:])) for m in _MARKS.finditer(text) if (at := m.end()) < len(text)]
    for run in _BLANKS.finditer(text):
        at = run.end()
        if run.start() == 0 or at == len(text):
            continue
        before = text[max(0, run.start() - 8) : at]
        if "\n" in run[0]:
            rules = _RULES
        elif before[-len(run[0]) - 1] in ".?!。,;:、，'\"”’)]":
            rules = _RULES[7:]
        else:
            rules = _RULES[9:]
        for strength, head, tail in rules:
            if (not head or head.search(before)) and (not tail or tail.match(text, at)):
                found.append((at, strength))
                break
    return sorted(found)


def atoms(text: str, most: int) -> list[tuple[int, int]]:
    """(start, strength of the boundary there) of segments of at most ``most`` code points."""
    cuts = [(0, 0), *boundaries(text)]
    out = []
    for (start, strength), stop in zip(cuts, [*(c[0] for c in cuts[1:]), len(text)], strict=True):
        out.append((start, strength))
        while stop - start > most:
            room = text[start : start + most]
            cut = len(room)
            # the last cluster may go on beyond the room, then it moves to the next segment
            last = max(room.rfind(" "), room.rfind("\n"), len(room) - 64, 0)
            ends = [last + m.end() for m in _CLUSTERS.finditer(text[start + last : min(stop, start + most + 64)])]
            cut = max([e for e in ends if 0 < e <= most], default=cut)
            start += cut
            out.append((start, 0))
    return out


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, stop) of the pieces' own parts; a piece reads from ``max(0, start - overlap)``."""
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    segments = atoms(text, limit - overlap)
    n = len(segments)
    starts = [*(s for s, _ in segments), len(text)]
    after, before = [*range(1, n + 1)], [*range(-1, n)]
    heap = [(segments[i][1], starts[i + 1] - starts[i - 1], i) for i in range(1, n)]
    heapify(heap)
    while heap:
        strength, size, i = heappop(heap)
        left, right = before[i], after[i]
        now = starts[right] - starts[left]
        if now != size:
            # a side has grown since: sizes only grow, so the pair goes back to where it belongs now
            if now + (overlap if left else 0) <= limit:
                heappush(heap, (strength, now, i))
        elif now + (overlap if left else 0) <= limit:
            after[left] = right
            if right < n:
                before[right] = left
    pieces, i = [], 0
    while i < n:
        pieces.append((starts[i], starts[after[i]]))
        i = after[i]
    return pieces


def pieces_of(text: Column | str, limit: int, overlap: int) -> Column:
    """Column of the pieces of a text column."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")

    @F.arrow_udf(PIECES)
    def pieces(texts: pa.Array) -> pa.Array:
        rows = [
            [{"piece_no": k, "start": (a := max(0, s - overlap)), "stop": e, "piece": x[a:e]} for k, (s, e) in enumerate(split_text(x, limit, overlap))] if x else []
            for x in texts.to_pylist()
        ]
        piece = pa.struct([("piece_no", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("piece", pa.string())])
        return pa.array(rows, pa.list_(piece))

    return pieces(text)


def split_oversized(items: DataFrame, text: str, limit: int, overlap: int) -> DataFrame:
    """The rows whose text exceeds the limit, with a column ``pieces``; the filter runs before Python sees a row."""
    return items.filter(F.length(text) > limit).withColumn("pieces", pieces_of(text, limit, overlap))

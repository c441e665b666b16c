"""Splitting oversized items at natural boundaries (problem 5).

Agglomerative merging: a text is cut into atoms at every natural boundary (paragraph, line, sentence, clause, word);
adjacent atoms sit in a heap keyed by the strength of the boundary between them, and the weakest boundary is merged
first while the combined size plus the overlap fits the limit. What stays unmerged are the strongest boundaries that
the limit allows.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_arrow

#: Natural boundaries by strength; a boundary lies at the end of a match.
BOUNDARIES = (
    (5, re.compile(r"\n[ \t\r]*\n\s*|\f\s*")),
    (4, re.compile(r"\n")),
    (3, re.compile(r"[.!?…][\"”’»)\]]*\s+")),
    (2, re.compile(r"[,;:]\s+")),
    (1, re.compile(r"\s+")),
)


def boundaries(text: str, finest: int = 1) -> dict[int, int]:
    """Position -> strength of every natural boundary inside the text, down to the given strength."""
    found: dict[int, int] = {}
    for strength, pattern in BOUNDARIES:
        if strength >= finest:
            for m in pattern.finditer(text):
                found.setdefault(m.end(), strength)
    found.pop(len(text), None)
    found.pop(0, None)
    return found


def cut_points(text: str, max_chars: int, overlap: int) -> list[int]:
    """Ends of the pieces' own parts, the last being len(text); [] if the text fits whole.

    max_chars < 1 is an error; an overlap of max_chars or more is lowered to max_chars - 1, a negative one to 0.
    """
    if max_chars < 1:
        raise ValueError("max_chars must be at least 1")
    overlap = max(0, min(overlap, max_chars - 1))
    n = len(text)
    if n <= max_chars:
        return []
    room = max_chars - overlap
    strength = _atoms(text, n, room)
    cuts = _merge([0, *sorted(strength), n], strength, max_chars, overlap)
    if overlap and cuts[0] < overlap:
        cuts = _first_longer(cuts, strength, max_chars, overlap)
    return cuts


def _atoms(text: str, n: int, room: int) -> dict[int, int]:
    """Boundaries that leave no atom longer than the room beside the overlap: finer ones are used only where needed."""
    strength = boundaries(text, 3)
    edges = [0, *sorted(strength), n]
    for a, b in zip(edges, edges[1:]):
        if b - a > room:
            for pos, s in boundaries(text[a:b]).items():
                strength.setdefault(a + pos, s)
    edges = [0, *sorted(strength), n]
    for a, b in zip(edges, edges[1:]):
        for pos in range(a + room, b, room):
            strength[pos] = 0
    return strength


def _merge(edges: list[int], strength: dict[int, int], max_chars: int, overlap: int) -> list[int]:
    """Merge atoms over their weakest boundaries first, ties smallest combined size first, until none fits."""
    last = len(edges) - 2
    left, right = list(range(-1, last)), list(range(1, last + 2))
    start, end, alive = edges[:-1], edges[1:], [True] * (last + 1)

    def entry(i: int, j: int) -> tuple[int, int, int, int]:
        return strength[end[i]], end[j] - start[i], i, j

    heap = [entry(i, i + 1) for i in range(last)]
    heapify(heap)
    while heap:
        s, size, i, j = heappop(heap)
        if not alive[i] or not alive[j] or end[j] - start[i] != size or right[i] != j:
            continue
        if size + (overlap if start[i] else 0) > max_chars:
            continue
        end[i], alive[j], right[i] = end[j], False, right[j]
        if right[i] <= last:
            left[right[i]] = i
            heappush(heap, entry(i, right[i]))
        if left[i] >= 0:
            heappush(heap, entry(left[i], i))
    return [e for e, a in zip(end, alive) if a]


def _first_longer(cuts: list[int], strength: dict[int, int], max_chars: int, overlap: int) -> list[int]:
    """A first piece shorter than the overlap takes over the head of the next one, so that the overlap can be whole."""
    while len(cuts) > 1 and cuts[0] < overlap:
        reach = cuts[1]
        if reach <= max_chars:
            cuts = cuts[1:]
            continue
        low, high = max(overlap, reach + overlap - max_chars), min(max_chars, reach - 1)
        inside = [(s, p) for p, s in strength.items() if low <= p <= high]
        cuts = [max(inside)[1] if inside else high, *cuts[1:]]
    return cuts


def pieces(text: str, max_chars: int, overlap: int) -> list[str]:
    """Ordered pieces of at most max_chars; each but the first begins with the last `overlap` characters before it."""
    overlap = max(0, min(overlap, max_chars - 1))
    begin, out = 0, []
    for end in cut_points(text, max_chars, overlap) or [len(text)]:
        out.append(text[max(0, begin - overlap) : end])
        begin = end
    return out


PIECES = "rec_table string, rec_id bigint, piece_no int, start_char int, overlap_chars int, content string"


def split_oversized(items: DataFrame, distinct_rows: bool = False) -> DataFrame:
    """Pieces of the items longer than their limit.

    items: rec_table, rec_id, text, max_chars, overlap_chars (others are ignored). Rows with a null text or limit, and
    rows that fit, give no rows. Repeated rows give repeated pieces, unless distinct_rows is set, which shuffles the
    oversized rows. Only these travel to Python.
    """
    over = items.filter(F.length("text") > F.col("max_chars")).select("rec_table", "rec_id", "text", "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))
    over = over.distinct() if distinct_rows else over

    def work(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("rec_table", "rec_id", "piece_no", "start_char", "overlap_chars", "content")}
        for rec_table, rec_id, text, limit, overlap in zip(*(cols[c] for c in ("rec_table", "rec_id", "text", "max_chars", "overlap_chars"))):
            overlap = max(0, min(overlap, limit - 1))
            begin = 0
            for no, end in enumerate(cut_points(text, limit, overlap)):
                low = max(0, begin - overlap)
                for k, v in zip(out, (rec_table, rec_id, no, low, begin - low, text[low:end])):
                    out[k].append(v)
                begin = end
        return out

    return map_arrow(over, PIECES, work)


def limited_records(documents: DataFrame, sections: DataFrame, limits: DataFrame) -> DataFrame:
    """Records of documents and sections with the limit of their kind; kinds are compared whatever their case.

    limits is the fixed table of limits (8 rows) and is broadcast for that reason.
    """
    limits = F.broadcast(limits.select(F.col("rec_table"), F.upper(F.trim("kind")).alias("kind"), "max_chars", "overlap_chars"))
    docs = documents.select(F.lit("documents").alias("rec_table"), F.col("doc_id").alias("rec_id"), "text", F.upper(F.trim("filetype")).alias("kind"))
    secs = sections.select(F.lit("sections").alias("rec_table"), F.col("section_id").alias("rec_id"), F.col("content").alias("text"), F.upper(F.trim("section_type")).alias("kind"))
    return docs.unionByName(secs).join(limits, ["rec_table", "kind"])

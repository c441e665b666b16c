"""Evaluation texts that leaked into training text (problem 8).

Wu-Manber multi-pattern search over words: the patterns are all runs of `run` words of the evaluation fields. A shift
table over blocks of two words tells how far the search may jump from a block that ends the current window; a shift
of zero leads to a bucket of patterns with that last block, and a direct comparison confirms an occurrence.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_arrow, words

BLOCK = 2
FIELDS = ("query", "expected_answer", "passage")


#: Entries of the shift table; blocks that meet in one have the lesser of their shifts, which costs time only.
TABLE = 1 << 22
_FACTOR = 2_654_435_761


class WuManber:
    """Searches word lists for every run of `run` words of the given fields: (case_id, field, words).

    Words are numbered, so that all fields are one array: 16 bytes a word, beside the vocabulary and the shift table.
    """

    def __init__(self, fields: list[tuple[int, str, list[str]]], run: int):
        if run < BLOCK:
            raise ValueError(f"run must be at least {BLOCK}")
        self.run = run
        kept = [f for f in fields if len(f[2]) >= run]
        self.names = [f[:2] for f in kept]
        self.numbers: dict[str, int] = {}
        number = self.numbers.setdefault
        flat = [number(w, len(self.numbers)) for f in kept for w in f[2]]
        sizes = np.array([len(f[2]) for f in kept], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.flat = np.array(flat, np.int32)
        self.table = bytearray([run - BLOCK + 1]) * TABLE
        self.keys = self.places = np.zeros(0, np.int64)
        if flat:
            ids = self.flat.astype(np.int64)
            key = (ids[:-1] << 32) | ids[1:]
            within = np.arange(len(flat)) - np.repeat(self.begin[:-1], sizes)  # place in its field of a block's first word
            inside = np.flatnonzero(within[:-1] + 1 == within[1:])
            shift = np.maximum(run - BLOCK - within[inside], 0).astype(np.uint8)
            np.minimum.at(np.frombuffer(self.table, np.uint8), (ids[inside] * _FACTOR + ids[inside + 1]) % TABLE, shift)
            # The buckets: where each last block of a pattern ends, sorted by block.
            last = inside[shift == 0]
            order = np.argsort(key[last], kind="stable")
            self.keys, self.places = key[last][order], last[order] + BLOCK - run

    def search(self, text: list[str]) -> dict[int, tuple[int, int]]:
        """Field number -> (first word, length) of its longest common run with the text, if at least `run` long."""
        run, table, numbers = self.run, self.table, self.numbers
        get, jump, end, n = numbers.get, run - BLOCK + 1, run, len(text)
        best: dict[int, tuple[int, int]] = {}
        reached: dict[int, int] = {}
        while end <= n:
            b = get(text[end - 1], -1)
            if b < 0:  # no pattern has the last word of the window
                end += run
                continue
            a = get(text[end - 2], -1)
            far = table[(a * _FACTOR + b) % TABLE] if a >= 0 else jump
            if far:
                end += far
                continue
            begin = end - run
            key = (a << 32) | b
            low = int(np.searchsorted(self.keys, key))
            window = None
            while low < len(self.keys) and self.keys[low] == key:
                at = int(self.places[low])
                low += 1
                if reached.get(begin - at, -1) >= end:
                    continue
                if window is None:
                    window = np.array([get(w, -1) for w in text[begin:end]], np.int32)
                if not np.array_equal(self.flat[at : at + run], window):
                    continue
                k = int(np.searchsorted(self.begin, at, "right")) - 1
                i, j, stop = end, at + run, int(self.begin[k + 1])
                while i < n and j < stop and get(text[i], -1) == self.flat[j]:
                    i, j = i + 1, j + 1
                reached[begin - at] = i
                if i - begin > best.get(k, (0, 0))[1]:
                    best[k] = (begin, i - begin)
            end += 1
        return best


LEAKS = "doc_id bigint, case_id bigint, field string, first_word int, n_words int"


def find_leaks(documents: DataFrame, cases: DataFrame, run: int = 10, block_chars: int = 64_000_000) -> DataFrame:
    """One row per document, case and field that share at least `run` consecutive words, with their longest such run.

    documents: doc_id, text; cases: case_id and any of query, expected_answer, passage. Null, blank and short texts
    match nothing; repeated cases count once; cases with equal texts are all reported. The cases are the stated query set.
    They go to the workers in blocks of about block_chars characters (some 250 MB), each searched in one pass over the
    documents, so that suites beyond that size need several.
    """
    present = [f for f in FIELDS if f in cases.columns]
    size = F.lit(0)
    for f in present:
        size = size + F.coalesce(F.length(f), F.lit(0))
    total = cases.agg(F.sum(size)).first()[0] or 0
    blocks = 1 + total // block_chars
    found = None
    for b in range(blocks):
        part = cases.filter(F.pmod(F.xxhash64("case_id"), F.lit(blocks)) == b) if blocks > 1 else cases
        fields = {(r["case_id"], f, tuple(words(r[f]))) for r in part.select("case_id", *present).toLocalIterator() for f in present if r["case_id"] is not None and r[f]}
        hits = _scan(documents, WuManber([(c, f, list(w)) for c, f, w in sorted(fields)], run))
        found = hits if found is None else found.unionByName(hits)
    return found


def _scan(documents: DataFrame, matcher: WuManber) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(matcher)

    def work(cols: dict[str, list]) -> dict[str, list]:
        m = shared.value
        rows = [(d, *m.names[k], at, n) for d, t in zip(cols["doc_id"], cols["text"]) for k, (at, n) in m.search(words(t)).items()]
        return dict(zip(("doc_id", "case_id", "field", "first_word", "n_words"), zip(*rows) if rows else [()] * 5))

    return map_arrow(documents.filter(F.length("text") > 0).select("doc_id", "text"), LEAKS, work)

"""Filling fixed-capacity containers with whole documents (problem 7).

Harmonic packing: an item of size s belongs to the reciprocal-capacity class k = floor(capacity / s), and a bin of class
k is given k items, which always fit. What room such a bin has left is topped up with the largest items of the
smaller classes that fit. Every task packs its own documents, in blocks, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_schema

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public splitting pattern of that byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_ITEMS = 50_000
CACHE_PIECES = 300_000

#: Runs of white space other than one space between words.
_RUN = re.compile(r"(\s\s+|[^\S ])")
#: White space to Python, not to the tokenizer.
_CONTROL = re.compile("[\x1c-\x1f]")


class TokenCounter(dict):
    """Counts the tokens of texts; keeps the counts of the pieces between single spaces, where no token spans."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_PIECES:
            self.clear()
        n = self[piece] = len(self.encode(piece if piece[:1].isspace() else " " + piece))
        return n

    def count(self, text: str | None) -> int:
        """The number of tokens of the whole text; 0 if null or empty.

        Tokens don't span the space before a word, and of a longer run of white space all but its last character is
        one stretch; so the counts of the pieces in between add up to that of the text.
        """
        if not text:
            return 0
        if _CONTROL.search(text):
            return len(self.encode(text))
        head, *parts = _RUN.split(text)
        first, *rest = head.split(" ")
        total = (len(self.encode(first)) if first else 0) + sum(map(self.__getitem__, rest))
        for run, words in zip(parts[::2], parts[1::2]):
            if not words:
                return total + self[run]
            if len(run) > 1:
                total += self[run[:-1]]
            pieces = words.split(" ")
            if run[-1] != " ":
                pieces[0] = run[-1] + pieces[0]
            total += sum(map(self.__getitem__, pieces))
        return total


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """The counter of a vocabulary file, loaded once in each worker."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def harmonic_bins(sizes: list[int], capacity: int, top_up: bool = True) -> list[list[int]]:
    """Bins of item numbers; sizes must be between 1 and capacity.

    Items are taken by size, largest first and ties by number, so that equal input gives equal bins.
    """
    stacks: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        stacks.setdefault(sizes[i], []).append(i)
    below = list(range(capacity + 1))  # below[s]: s if items of size s are left, else a lower size that may have some
    for s in range(1, capacity + 1):
        if s not in stacks:
            below[s] = s - 1

    def largest(s: int) -> int:
        path = []
        while below[s] != s:
            path.append(s)
            s = below[s]
        for p in path:
            below[p] = s
        return s

    def take(s: int) -> int:
        i = stacks[s].pop()
        if not stacks[s]:
            below[s] = s - 1
        return i

    bins = []
    while s := largest(capacity):
        k, room, own = capacity // s, capacity, []
        while len(own) < k and (s := largest(room)) and capacity // s == k:
            own.append(take(s))
            room -= s
        while top_up and room and (s := largest(room)):
            own.append(take(s))
            room -= s
        bins.append(own)
    return bins


ASSIGNED = "pool string, capacity_tokens int, container string, doc_id bigint, piece_no int, n_tokens int"


def pack_documents(documents: DataFrame, pools: DataFrame, tokenizer: str = TOKENIZER, block_items: int = BLOCK_ITEMS, top_up: bool = True) -> DataFrame:
    """(pool, capacity_tokens, container, doc_id, piece_no, n_tokens): every document's place.

    documents: doc_id, filetype, text; pools: filetype, capacity_tokens, a fixed table of few rows, which is broadcast. A
    document of more tokens than the capacity is cut into full pieces and a rest, piece_no counting from 0; others are
    whole, with piece_no 0. Documents without tokens (null or empty text) or without a pool have a null container.
    Repeated rows are packed as often as they occur. A container belongs to one task's block of at most block_items
    documents; each block leaves at most one container of each class part-filled.
    """
    pools = F.broadcast(pools.select("filetype", F.col("capacity_tokens").cast("int").alias("capacity_tokens")))
    joined = documents.select("doc_id", "filetype", "text").join(pools, "filetype", "left").select("doc_id", "filetype", "capacity_tokens", "text")
    arrow = arrow_schema(ASSIGNED)
    return joined.mapInArrow(_packer(arrow, tokenizer, block_items, top_up), ASSIGNED)


def _packer(arrow: pa.Schema, tokenizer: str, block_items: int, top_up: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), counter(tokenizer).count
        block: list[tuple[int, str, int | None, int]] = []
        serial = 0
        for batch in batches:
            ids, kinds, limits, texts = (c.to_pylist() for c in batch.columns)
            block += zip(ids, kinds, limits, map(count, texts))
            if len(block) >= block_items:
                yield pack(block, f"{task}-{serial}")
                block, serial = [], serial + 1
        if block:
            yield pack(block, f"{task}-{serial}")

    def pack(block: list[tuple[int, str, int | None, int]], label: str) -> pa.RecordBatch:
        rows: list[tuple] = []
        items: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
        for doc_id, kind, capacity, n in block:
            if not n or not capacity or capacity < 1:
                rows.append((kind, capacity, None, doc_id, 0, n))
                continue
            full, rest = divmod(n, capacity)
            for piece in range(full):
                rows.append((kind, capacity, f"{kind}-{label}-d{doc_id}-{piece}", doc_id, piece, capacity))
            if rest:
                items.setdefault((kind, capacity), []).append((doc_id, full, rest))
        for (kind, capacity), own in items.items():
            for b, members in enumerate(harmonic_bins([x[2] for x in own], capacity, top_up)):
                rows += [(kind, capacity, f"{kind}-{label}-{b}", *own[i]) for i in members]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return run


def container_fill(assigned: DataFrame) -> DataFrame:
    """(pool, containers, documents, tokens, fill): how full a packing is, fill being tokens over capacity used."""
    packed = assigned.filter(F.col("container").isNotNull())
    each = packed.groupBy("pool", "capacity_tokens", "container").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"))
    return each.groupBy("pool").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("documents"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / F.sum("capacity_tokens")).alias("fill"))

"""Near-duplicate records with small edits (problem 4).

PartEnum signatures: the domain of word shingles is partitioned, and what a set has in one part makes a signature, so
that two similar sets of one band of sizes agree in some part and share its signature. A band's pairs at the threshold
differ in at most a known number of shingles; from it follow how many parts there are and how many shingles a part must
hold to count (`band_plan`). Subsets of one part each give the fewest signatures. A set signs in its own band and in those
of the larger sets it may match. Of the pairs that share a signature, bits of sketches, the sizes and the parities of the
sets rule out most that are far apart; the rest are compared exactly, on the whole sets. Copies, records of one shingle
set, are one class and sign once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import ceil, comb, exp, floor, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WORD, arrow_schema, cut

#: Upper bounds of the band sizes grow by this factor.
BAND = 2.0
#: A pair at the threshold is missed by its signatures, or by the bits of its sketches, with at most this probability each; more similar ones with less.
MISS = 1e-5
MOST_SHINGLES = 8  # that a part has to hold to count
SKETCH_BITS = 64
#: Beyond so many copies they are sorted out by a shuffle of signatures instead of a broadcast of ids (some 50 bytes each).
BROADCAST_ROWS = 500_000
BLOCK_CHARS, BLOCK_RECORDS = 1 << 20, 2_000

_STEP, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _in_words() -> np.ndarray:
    """Which code points are letters or digits."""
    flags = np.zeros(0x110000, bool)
    every = "".join(map(chr, range(0x110000)))
    for m in WORD.finditer(every):
        flags[m.start() : m.end()] = True
    return flags


_FACTOR = 0xC2B2AE3D27D4EB4F


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a factor and of its inverse modulo 2^64."""
    out = []
    for base in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of an array of code points begins, and its hash, from one running sum over the block."""
    inside = _in_words()[codes]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = edge[::2], edge[1::2]
    hashes = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):  # whole words, about BLOCK_CHARS characters at a time
        upto = max(at + 1, int(np.searchsorted(end, begin[at] + BLOCK_CHARS)))
        low, high = int(begin[at]), int(end[upto - 1])
        size = BLOCK_CHARS if high - low <= BLOCK_CHARS else high - low
        power, inverse = _powers(size)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes[low:high].astype(np.uint64) * power[: high - low])])
            a, b = begin[at:upto] - low, end[at:upto] - low
            hashes[at:upto] = _mix((total[b] - total[a]) * inverse[a])
        at = upto
    return begin, hashes


def _distinct(hashes: np.ndarray) -> np.ndarray:
    ordered = np.sort(hashes)
    return ordered[np.diff(ordered, prepend=~ordered[:1]) != 0]


def shingle_sets(texts: list[str], size: int, min_words: int) -> Iterator[np.ndarray | None]:
    """For each text the sorted distinct hashes of all its runs of `size` words, None for texts of fewer than min_words words."""
    least, at = max(size, min_words, 1), 0
    while at < len(texts):
        block, chars = [], 0
        while at < len(texts) and (not block or chars + len(texts[at]) <= BLOCK_CHARS):
            block.append(texts[at].lower())
            chars += len(texts[at])
            at += 1
        offsets = np.cumsum([0, *(len(t) + 1 for t in block)])
        begin, h = word_hashes(np.frombuffer("\n".join(block).encode("utf-32-le", "surrogatepass"), np.uint32))
        runs = np.zeros(max(0, len(h) - size + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                runs = _mix(runs * _STEP + h[k : k + len(runs)])
        first = np.searchsorted(begin, offsets)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            yield _distinct(runs[a : b - size + 1]) if b - a >= least else None


def shingles(text: str, size: int, min_words: int) -> np.ndarray | None:
    """The shingle set of one text; see shingle_sets."""
    return next(shingle_sets([text], size, min_words))


def _long(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _missed(parts: int, least: int, d: int, c: int) -> float:
    """A bound of the probability that no part holds `least` of the c shingles of a pair in common and none of the d others."""
    if parts == 1:
        return float(d > 0 or c < least)
    q = 1 / parts
    held = 1 - sum(comb(c, i) * q**i * (1 - q) ** (c - i) for i in range(least)) if c < 2000 else 1 - sum(exp(i * log(c * q) - c * q) / (1, 1, 2, 6, 24, 120, 720, 5040)[i] for i in range(least))
    good = (1 - q) ** d * max(held, 0.0)
    bound = exp(parts * log1p(-good)) if good < 1 else 0.0  # the parts' numbers of shingles are negatively associated
    if least > 1 or d > 64:
        return bound
    taken = np.zeros(d + 2)  # how many parts the d others fall into; all in common must fall into these as well
    taken[0] = 1
    m = np.arange(d + 2)
    for _ in range(d):
        taken[1:] = taken[1:] * m[1:] * q + taken[:-1] * np.maximum(1 - m[:-1] * q, 0)
        taken[0] = 0
    return min(bound, float((taken * (np.minimum(m, parts) * q) ** c).sum()))


def band_edge(band: int) -> int:
    """The largest set of a band."""
    return floor(BAND**band + 1e-9)


@lru_cache(maxsize=65_536)
def band_of(n: int) -> int:
    band = max(0, ceil(log(n) / log(BAND) - 1e-9))
    return band if n <= band_edge(band) else band + 1


@lru_cache(maxsize=4096)
def band_plan(band: int, threshold: float) -> tuple[int, int]:
    """(parts, least): into how many parts the domain falls for a band, and how many shingles of a set a part must hold.

    The plan of fewest signatures that misses no pair of the band at the threshold with more than MISS; 0 parts stand for
    every shingle by itself, which misses none.
    """
    low, high = (band_edge(band - 1) if band else 0) + 1, band_edge(band)
    sums = np.unique(np.linspace(ceil(low * (1 + threshold) - 1e-9), 2 * high, min(2 * high, 400) if high < 100 else 5).astype(int))
    hardest: dict[int, int] = {}  # of pairs with as many others, those with the fewest in common
    for s in sums.tolist():
        d = floor(s * (1 - threshold) / (1 + threshold) + 1e-9)
        hardest[d] = min(hardest.get(d, s), (s - d) // 2)
    pairs = sorted(hardest.items())
    best = (float(high), 0, 1)
    n = (low + high) / 2
    for least in range(1, MOST_SHINGLES + 1):
        first = max(1, pairs[-1][0] // 12)
        for parts in range(first, high):
            if parts >= best[0] * 2:
                break
            if all(_missed(parts, least, d, c) <= MISS for d, c in reversed(pairs)):
                mean = n / parts
                signed = parts * (1 - sum(exp(-mean) * mean**i / (1, 1, 2, 6, 24, 120, 720, 5040)[i] for i in range(least)))
                best = min(best, (signed, parts, least))
                break
    return best[1:]


def bands(n: int, threshold: float) -> range:
    """The bands in which a set of n shingles signs: its own and those of the larger sets that it may match."""
    return range(band_of(n), band_of(floor(n / threshold + 1e-9)) + 1)


def most_apart(threshold: float) -> int:
    """In how many bits the sketches of a pair at the threshold may differ."""
    p, tail = (1 - threshold) / 2, 0.0
    for k in range(SKETCH_BITS, -1, -1):
        tail += comb(SKETCH_BITS, k) * p**k * (1 - p) ** (SKETCH_BITS - k)
        if tail > MISS:
            return k
    return 0


#: Up to this size of a band its sketches are of minima under several functions, beyond it of the minima of several ranges of one function, none of which is empty then.
MINIMA_EDGE = 250
_FUNCTIONS = _mix(np.arange(1, SKETCH_BITS + 1, dtype=np.uint64) * _SALT) | np.uint64(1)
BLOCK_SHINGLES = 16_384


def _sketches(flat: np.ndarray, of: np.ndarray, starts: np.ndarray, band: int) -> np.ndarray:
    """For each set 64 bits, one of each of 64 minima: two sets differ in each with half their dissimilarity.

    flat holds the sets one after the other, each sorted, `of` their numbers, `starts` where each begins.
    """
    n = len(starts)
    bits = np.zeros((n, SKETCH_BITS), np.uint8)
    if band_edge(band) > MINIMA_EDGE:
        cell = of * SKETCH_BITS + (flat >> np.uint64(58)).astype(np.int64)
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        bits.ravel()[cell[first]] = (flat[first] & np.uint64(1)).astype(np.uint8)
    else:
        at = 0
        while at < n:
            upto = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK_SHINGLES, "right")) - 1) if starts[-1] - starts[at] > BLOCK_SHINGLES else n
            low, high = starts[at], starts[upto] if upto < n else len(flat)
            least = np.minimum.reduceat(_mix(flat[low:high])[:, None] * _FUNCTIONS, starts[at:upto] - low, axis=0)
            bits[at:upto] = (_mix(least) & np.uint64(1)).astype(np.uint8)
            at = upto
    return np.packbits(bits, axis=1).view(np.int64).ravel()


def _signatures(flat: np.ndarray, of: np.ndarray, n: int, threshold: float, band: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of n sets in a band, and of which set each is."""
    parts, least = band_plan(band, threshold)
    salt = np.uint64((band + 1) * int(_SALT) % 2**64)
    mixed = _mix(flat + _SALT)
    if not parts:
        return _mix(mixed + salt), of
    cell = of * parts + (((flat >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)  # ascending
    begin = np.flatnonzero(np.diff(cell, prepend=-1))
    counts = np.diff(begin, append=len(cell))
    kept = counts >= least
    sums = np.add.reduceat(mixed, begin)[kept]
    own, part = np.divmod(cell[begin[kept]], parts)
    return _mix(sums + (part.astype(np.uint64) + np.uint64(1)) * _STEP + salt), own


def sign(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set number, signature, low) of every signature of the sets in all their bands.

    low is the sketch of the set in that band but for the lowest bit, which tells whether the band is that of its own size.
    """
    members: dict[int, list[int]] = {}
    for k, own in enumerate(sets):
        for band in bands(len(own), threshold):
            members.setdefault(band, []).append(k)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    with np.errstate(over="ignore"):
        for band, numbers in members.items():
            sizes = np.array([len(sets[k]) for k in numbers])
            flat, of = np.concatenate([sets[k] for k in numbers]), np.repeat(np.arange(len(numbers)), sizes)
            found, own = _signatures(flat, of, len(numbers), threshold, band)
            at_home = np.array([band_of(int(n)) == band for n in sizes])
            low = _sketches(flat, of, np.cumsum(sizes) - sizes, band) & ~np.int64(1) | at_home
            out.append((np.array(numbers)[own], found.view(np.int64), low[own]))
    a, b, c = (np.concatenate(x) for x in zip(*out))
    return a, b, c


#: parities: 256 bits, each the parity of the shingles that fall on it; two sets differ in at least as many shingles as bits.
PARITIES = 4
DIGEST = "rec_table string, rec_id bigint, set1 bigint, set2 bigint, n int, " + ", ".join(f"parity{k} bigint" for k in range(PARITIES))
SIGNED = "rec_table string, rec_id bigint, signature bigint, low bigint"
SIGNED_SETS = "rec_table string, rec_id bigint, set1 bigint, set2 bigint, signed array<struct<signature: bigint, low: bigint>>"


def _digest(own: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(own.tobytes())
    return _long(digest >> 64), _long(digest & (2**64 - 1))


def _each(items: DataFrame, schema: str, size: int, min_words: int, rows: Callable[[list, list, list[np.ndarray]], list]) -> DataFrame:
    """Apply rows to the tables, ids and shingle sets of each batch of records; short and null texts are left out."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_RECORDS):
                tables, ids, texts = (c.to_pylist() for c in batch.slice(at, BLOCK_RECORDS).columns)
                kept = [(t, i, s) for t, i, s in zip(tables, ids, shingle_sets(texts, size, min_words)) if s is not None]
                if kept:
                    columns = rows(*map(list, zip(*kept)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return items.filter(F.length("text") > 0).select("rec_table", "rec_id", "text").mapInArrow(run, schema)


def digests(items: DataFrame, size: int, min_words: int) -> DataFrame:
    """The fingerprint (set1, set2), size and parities of each record's shingle set."""

    def rows(tables: list, ids: list, sets: list[np.ndarray]) -> list:
        cell = np.repeat(np.arange(len(sets)), [len(x) for x in sets]) * (64 * PARITIES) + (np.concatenate(sets) >> np.uint64(56)).astype(np.int64)
        odd = (np.bincount(cell, minlength=len(sets) * 64 * PARITIES) & 1).astype(np.uint8)
        parities = np.packbits(odd.reshape(len(sets), -1), axis=1).view(np.int64)
        return [tables, ids, *zip(*map(_digest, sets)), [len(x) for x in sets], *parities.T]

    return _each(items, DIGEST, size, min_words, rows)


def signed(items: DataFrame, threshold: float, size: int, min_words: int) -> DataFrame:
    """(rec_table, rec_id, signature, low): one row for each signature of each record."""

    def rows(tables: list, ids: list, sets: list[np.ndarray]) -> list:
        own, found, low = sign(sets, threshold)
        return [pa.DictionaryArray.from_arrays(own.astype(np.int32), pa.array(tables)).cast(pa.string()), np.array(ids, np.int64)[own], found, low]

    return _each(items, SIGNED, size, min_words, rows)


def representatives_signed(items: DataFrame, classes: DataFrame, copies: DataFrame, threshold: float, size: int, min_words: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The signatures of one record of each class.

    Few copies are taken out by a broadcast of their ids. Where there are more than broadcast_rows, every record is
    signed in one row and meets the representatives by its fingerprint.
    """
    if copies.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return signed(items.join(F.broadcast(copies), ["rec_table", "rec_id"], "left_anti"), threshold, size, min_words)

    def rows(tables: list, ids: list, sets: list[np.ndarray]) -> list:
        signed: list[list[dict]] = [[] for _ in sets]
        for k, x, y in zip(*(c.tolist() for c in sign(sets, threshold))):
            signed[k].append({"signature": x, "low": y})
        return [tables, ids, *zip(*map(_digest, sets)), signed]

    every = _each(items, SIGNED_SETS, size, min_words, rows)
    first = classes.select("rec_table", "set1", "set2", F.col("rep_id").alias("rec_id"))
    return every.join(first, ["rec_table", "set1", "set2", "rec_id"], "left_semi").select("rec_table", "rec_id", F.inline("signed"))


def candidates(signed_records: DataFrame, threshold: float) -> DataFrame:
    """(rec_table, rep_a, rep_b), rep_a < rep_b: the pairs that share a signature and whose sketches are near enough.

    Texts of one kind share some signatures by chance; the bits that travel with a signature rule most of these out
    within the join, so that what leaves it grows with the pairs there are. A pair counts in the band of the larger set.
    """
    columns = ("signature", "rec_table", "rec_id", "low")
    a, b = (signed_records.select(*(F.col(c).alias(f"{c}_{side}") for c in columns)) for side in "ab")
    differ = F.bit_count(F.shiftrightunsigned(F.col("low_a").bitwiseXOR(F.col("low_b")), 1))
    near = (differ <= most_apart(threshold)) & ((F.col("low_a").bitwiseOR(F.col("low_b")) % 2) != 0)
    same = (F.col("signature_a") == F.col("signature_b")) & (F.col("rec_table_a") == F.col("rec_table_b")) & (F.col("rec_id_a") < F.col("rec_id_b"))
    return a.join(b.hint("merge"), same & near).select(F.col("rec_table_a").alias("rec_table"), F.col("rec_id_a").alias("rep_a"), F.col("rec_id_b").alias("rep_b")).distinct()


def near_enough(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sizes and parities leave it possible that they reach the threshold; rules out no other."""
    measures = ["n", *(f"parity{k}" for k in range(PARITIES))]
    for side in "ab":
        pairs = pairs.join(classes.select("rec_table", F.col("rep_id").alias(f"rep_{side}"), *(F.col(m).alias(f"{m}_{side}") for m in measures)), ["rec_table", f"rep_{side}"])
    differ = sum((F.bit_count(F.col(f"parity{k}_a").bitwiseXOR(F.col(f"parity{k}_b"))) for k in range(PARITIES)), F.lit(0))
    most = F.floor((F.col("n_a") + F.col("n_b")) * ((1 - threshold) / (1 + threshold)) + 1e-6)
    return pairs.filter((differ <= most) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (threshold - 1e-9))).select("rec_table", "rep_a", "rep_b").distinct()


#: Bits of the map of wanted records, in buckets of as many bits as Spark's bitmap functions use: 512 KB at any scale.
BUCKET_BITS, BUCKETS = 32_768, 128


def _wanted(pairs: DataFrame) -> np.ndarray:
    """A bit map of the hashes of the paired records; of fixed size, so that ever more other records pass it as it fills."""
    ids = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("id")).select(F.pmod(F.xxhash64("id"), F.lit(BUCKET_BITS * BUCKETS)).alias("bit"))
    maps = ids.groupBy(F.floor(F.col("bit") / BUCKET_BITS).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod(F.col("bit"), F.lit(BUCKET_BITS))).alias("bits"))
    out = np.zeros((BUCKETS, BUCKET_BITS), bool)
    for r in maps.collect():  # at most BUCKETS rows
        out[r["bucket"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
    return out.ravel()


def compare(items: DataFrame, pairs: DataFrame, threshold: float, size: int, min_words: int) -> DataFrame:
    """(rec_table, rep_a, rep_b, similarity): the pairs whose whole shingle sets are similar enough.

    Only records that may be in a pair are tokenised again and shuffled.
    """
    bits = items.sparkSession.sparkContext.broadcast(_wanted(pairs))
    bit = F.pmod(F.xxhash64("rec_id"), F.lit(BUCKET_BITS * BUCKETS))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(bits.value[batch.column(2).to_numpy(zero_copy_only=False)]))
            if kept.num_rows:
                sets = [np.zeros(0, np.int64) if s is None else s.view(np.int64) for s in shingle_sets(kept.column(3).to_pylist(), size, min_words)]
                flat = pa.array(np.concatenate(sets)) if sets else pa.array([], pa.int64())
                arrays = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), flat)
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), arrays], names=["rec_table", "rec_id", "shingle"])

    texts = items.filter(F.length("text") > 0).select("rec_table", "rec_id", bit.alias("bit"), "text")
    sets = texts.mapInArrow(sets_of, "rec_table string, rec_id bigint, shingle array<bigint>")
    joined = pairs.join(sets.withColumnsRenamed({"rec_id": "rep_a", "shingle": "shingle_a"}), ["rec_table", "rep_a"]).join(sets.withColumnsRenamed({"rec_id": "rep_b", "shingle": "shingle_b"}), ["rec_table", "rep_b"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, ends_x), (y, ends_y) = ((c.flatten().to_numpy(), c.value_lengths().to_numpy().cumsum()) for c in batch.columns[3:])
            found = np.zeros(batch.num_rows)
            for k, (a, b) in enumerate(zip(np.split(x, ends_x[:-1]), np.split(y, ends_y[:-1]))):
                both = np.sort(np.concatenate([a, b]))
                common = int((both[1:] == both[:-1]).sum())  # each set has a shingle once
                found[k] = common / max(1, len(a) + len(b) - common)
            kept = found >= threshold - 1e-12
            yield pa.RecordBatch.from_arrays([*(c.filter(pa.array(kept)) for c in batch.columns[:3]), pa.array(found[kept])], names=["rec_table", "rep_a", "rep_b", "similarity"])

    return joined.select("rec_table", "rep_a", "rep_b", "shingle_a", "shingle_b").mapInArrow(similar, "rec_table string, rep_a bigint, rep_b bigint, similarity double").distinct()


def near_duplicates(items: DataFrame, threshold: float = 0.8, size: int = 5, min_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """Classes of copies, and the links between them.

    items: rec_table, rec_id, text. Gives (rec_table, rec_id, rep_id), one row for each record of at least min_words
    words with the least id among those of the same shingle set, and (rec_table, rep_a, rep_b, similarity) with
    rep_a < rep_b, the classes linked. Links are only within a rec_table. Null, empty and short texts give no rows;
    repeated rows count once; an id with several texts belongs to the class of each. Fingerprints and candidate pairs are cut
    to the checkpoint folder, so this starts jobs.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie between 0 and 1")
    found = cut(digests(items, size, min_words))
    measures = ["n", *(f"parity{k}" for k in range(PARITIES))]
    classes = found.groupBy("rec_table", "set1", "set2").agg(F.min("rec_id").alias("rep_id"), F.max("rec_id").alias("last_id"), *(F.first(m).alias(m) for m in measures))
    copied = classes.filter("last_id <> rep_id").select("rec_table", "set1", "set2", "rep_id")
    member = found.select("rec_table", "rec_id", "set1", "set2").join(copied, ["rec_table", "set1", "set2"], "left").select("rec_table", "rec_id", F.coalesce("rep_id", "rec_id").alias("rep_id")).distinct()
    copies = cut(member.groupBy("rec_table", "rec_id").agg(F.bool_or(F.col("rep_id") == F.col("rec_id")).alias("first")).filter("not first").select("rec_table", "rec_id"))
    by_chance = candidates(representatives_signed(items, classes, copies, threshold, size, min_words), threshold)
    pairs = cut(near_enough(by_chance, classes, threshold))
    return member, compare(items, pairs, threshold, size, min_words)


def expand_pairs(member: DataFrame, links: DataFrame) -> DataFrame:
    """(rec_table, id_a, id_b), id_a < id_b: the pairs of records within and between linked classes."""
    others = member.filter("rep_id <> rec_id")
    several = cut(others.unionByName(others.select("rec_table", F.col("rep_id").alias("rec_id"), "rep_id").distinct()))
    a = several.select("rec_table", F.col("rep_id").alias("rep_a"), F.col("rec_id").alias("x"))
    b = several.select("rec_table", F.col("rep_id").alias("rep_b"), F.col("rec_id").alias("y"))
    between = links.join(a, ["rec_table", "rep_a"], "left").join(b, ["rec_table", "rep_b"], "left").select("rec_table", F.coalesce("x", "rep_a").alias("x"), F.coalesce("y", "rep_b").alias("y"))
    within = a.join(b.withColumnRenamed("rep_b", "rep_a"), ["rec_table", "rep_a"]).filter("x < y").select("rec_table", "x", "y")
    return between.unionByName(within).select("rec_table", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

"""Noise in text from scanned pages (problem 6).

Running heads, page numbers and cut words are told by their shape and by what is known of the record's title and
site. Misread characters are found with a symmetric-delete index over the corpus's own frequency lexicon: a word with a confusable
piece deleted and a more frequent word with the matching piece deleted meet under one key; the weight of the
confusion and the frequencies, and the bigram context where there are several candidates, pick the repair. The lexicon is a
distributed table, joined by words, never collected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, map_arrow

#: What scanners read, what stood there, and the weight of that edit; other edits aren't taken for misreadings.
CONFUSIONS = (
    ("c", "e", 0.3), ("ri", "n", 0.3), ("f", "t", 0.3), ("cl", "d", 0.3), ("rn", "m", 0.2), ("b", "h", 0.4), ("vv", "w", 0.2), ("ii", "ü", 0.3),
    ("h", "li", 0.4), ("m", "rn", 0.4), ("a", "ä", 0.5), ("o", "ö", 0.5), ("u", "ü", 0.5),
    ("5", "s", 0.1), ("0", "o", 0.1), ("1", "l", 0.1), ("1", "i", 0.2), ("|", "i", 0.1), ("|", "l", 0.2), ("9", "g", 0.1), ("6", "b", 0.3), ("8", "b", 0.3),
)
LEAST_LETTERS, LEAST_COUNT, LEAST_RATIO = 4, 5, 8

_WORD = re.compile(r"[^\W\d_]+")
#: Words of a text in lower case, by ranges of letters, which match faster than classes.
_LOWER = re.compile("[a-zß-öø-ɏͰ-῿]+")
_INNER_HYPHEN = re.compile(r"-(?<=[^\W\d_]-)(?=[^\W\d_])")
_MIXED = re.compile(r"(?<![^\s\"“„«»”’'(\[,;:.-])(?=[^\s]*[0-9|])([^\W_]*[^\W\d_](?:[^\W_]|\|)*)(?=[\s\"”“«»’'),.;:!?\]-]|$)")
_BESIDE_DIGIT = re.compile(r"[^\W\d_][0-9|]|[0-9|][^\W\d_]")
_HYPHENS = "-‐­¬"
_CUT = {
    False: re.compile(rf"[{_HYPHENS}](?<=[^\W\d_].)[ \t]*[\n\x0c][ \t]*(?=[^\W\d_])"),
    True: re.compile(rf"[{_HYPHENS}](?<=[^\W\d_].) (?=[^\W\d_])"),
}
#: Words that follow a hyphen left hanging on purpose, as in "pre- and post-".
_JOINERS = frozenset("and or to und oder bzw bis et ou y e o u en of tot als".split())

_NUMBER = r"(?:Page \d+ of \d+|Seite \d+(?: von \d+)?|S\. ?\d+|p\. ?\d+|[-–—] ?\d+ ?[-–—]|\[\d+\]|\d+ ?/ ?\d+)"
_OWN_NUMBER = re.compile(rf"^[ \t]*(?:{_NUMBER}|\d+)[ \t]*$", re.IGNORECASE)
_EDGE_NUMBER = re.compile(rf"(?:(?<=[^\W\d_.,;:!?»”)])(?=Page|Seite|[-–—\[])|(?<=\s\s)|(?<=\x0c))(?:{_NUMBER})[ \t]*$|^[ \t]*(?:{_NUMBER})(?=\s{{2,}}|\x0c)", re.IGNORECASE)
_BLOCK_NUMBER = re.compile(r"(?<=\s)(?:Page \d+ of \d+|S\. \d+|[-–—] \d+ [-–—]|\[\d+\]|\d+/\d+)(?=\s|$)")
_CODE = r"[A-Z]{2,5} \d{3,5}-\d"
#: A whole line of a site's name and a code.
_SITE_CODE = re.compile(rf"^([^\W\d_][\w|]*)(?: ·)? {_CODE}$")


#: The end of a line before a head that isn't a mark of a heading.
_GLUED = re.compile(r"[^\W_][^#\w]*$")


def is_wrapped(text: str, least: int = 20, most: int = 80, share: float = 0.6) -> bool:
    """Whether the lines of a text are those of a page: several, most of them of nearly one width."""
    lengths = [len(x) for x in text.split("\n") if x.strip()]
    return len(lengths) >= 4 and sum(least < n < most for n in lengths) >= share * len(lengths) and max(lengths) < 2 * most


@lru_cache(maxsize=8192)
def head_pattern(title: str | None, source: str | None, code: str | None = None) -> re.Pattern | None:
    """What a running head of a record may read: its title, its site with a code, or a code with the title's subject.

    Where title or site aren't known, its own code (the number of the file) tells a head by itself.
    """
    forms = [rf"(?:\w+ · )?{re.escape(code.strip())}"] if code and len(code.strip()) >= 4 and not (title and source) else []
    site = (source or "").split(".")
    if len(site) >= 2:
        forms.append(rf"{re.escape(site[-2])}(?: ·)? {_CODE}")
    if title and len(title.strip()) >= 4:
        title = title.strip()
        subject = title.split(":")[0].strip()
        for t, sub in {(title, subject), (title.upper(), subject.upper())}:  # capitals may be longer, as those of sharp s
            forms += [re.escape(t), rf"{_CODE} {re.escape(sub)}"]
    return re.compile("|".join(f"(?:{f})" for f in forms), re.IGNORECASE) if forms else None


_CLASSES = [(x, y) for x, y, _ in sorted(CONFUSIONS, key=lambda c: -len(c[0])) if len(x) > 1]
_CLASS_OF = {x: y for x, y, _ in CONFUSIONS if len(x) == 1 == len(y)} | {"i": "l", "|": "l", "1": "l"}
_CLASS_OF = str.maketrans({x: _CLASS_OF.get(y, y) for x, y in _CLASS_OF.items()})


def read_alike(text: str) -> str:
    """A text in lower case with what scanners take for each other made equal, so that misread copies of it meet."""
    text = text.lower()
    for x, y in _CLASSES:
        text = text.replace(x, y)
    return text.translate(_CLASS_OF)


def _nearly(line: str, title: str) -> bool:
    """Whether a line is the title with a few misread characters."""
    if abs(len(line) - len(title)) > 6 or read_alike(line) == read_alike(title):
        return abs(len(line) - len(title)) <= 6
    if abs(len(line) - len(title)) > 3 or len(title) < 8:
        return False
    from difflib import SequenceMatcher

    return SequenceMatcher(None, line.lower(), title.lower(), autojunk=False).ratio() >= 0.88


def _repeated_lines(text: str, most: int | None = None) -> list[tuple[int, int]]:
    """Spans of the short lines of several words, without end punctuation, that stand in a text more than once, misread or not.

    With more than `most` different ones they are entries of lists, not heads.
    """
    seen: dict[str, list[tuple[int, int]]] = {}
    for m in re.finditer(r"[^\n\x0c]+", text):
        line = m.group().strip()
        if 8 <= len(line) <= 90 and not _OWN_NUMBER.match(line) and len(_WORD.findall(line)) >= 2 and not re.search(rf"[{_HYPHENS}.,;:!?]$", line):
            seen.setdefault(read_alike("".join(_WORD.findall(line))), []).append(m.span())
    repeated = [spans for spans in seen.values() if len(spans) > 1]
    return [span for spans in repeated for span in spans] if most is None or len(repeated) <= most else []


def _beside_number(line: str, after_number: bool) -> str:
    """What stands in a line beside a page number, or the line if a page number stands above it."""
    rest = _EDGE_NUMBER.sub("", line)
    return rest.strip() if len(rest) < len(line) else line if after_number else ""


def page_parts(text: str, title: str | None, source: str | None, block: bool, code: str | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans of running heads and of page numbers."""
    heads: list[tuple[int, int]] = []
    numbers: list[tuple[int, int]] = []
    low = text.lower()
    told_by = [(source or "").split(".")[-2] if "." in (source or "") else "", code or "", *((t.split(":")[0] for t in (title.strip(), title.upper().strip())) if title else ())]
    pattern = head_pattern(title, source, code) if any(x and x.strip().lower() in low for x in told_by) else None
    if block:
        if pattern:
            heads = [m.span() for m in pattern.finditer(text)]
        if _OWN_NUMBER.match(text):
            return heads, [(0, len(text))]
        numbers = [m.span() for m in _BLOCK_NUMBER.finditer(text)]
        for _, end in heads:  # a bare number can be told only beside a head
            if m := re.match(r" \d{1,4}(?=\s|$)", text[end:]):
                numbers.append((end + 1, end + m.end()))
        if heads and (m := re.match(r"\d{1,4} (?=$)", text[: heads[0][0]])):
            numbers.append((0, m.end()))
        return heads, sorted(set(numbers))
    at, titles, after_number = 0, [], False
    site = read_alike((source or "").split(".")[-2]) if "." in (source or "") else None
    for k, line in enumerate(re.split(r"(?<=[\n\x0c])", text)):
        bare = line.strip()
        begin = at + line.find(bare) if bare else at
        if bare and _OWN_NUMBER.match(bare):
            numbers.append((begin, begin + len(bare)))
        elif bare and (m := _SITE_CODE.match(bare)) and site in (None, read_alike(m.group(1))):
            heads.append((begin, begin + len(bare)))
        elif bare and title and (own := _beside_number(bare, after_number)) and abs(len(own) - len(title)) <= 6 and read_alike(own) == read_alike(title.strip()):
            # The title in one line with a page number, or below one, is a head.
            if m := _EDGE_NUMBER.search(line.rstrip("\n\x0c")):
                numbers.append((at + m.start(), at + m.end()))
            heads.append((at + line.find(own), at + line.find(own) + len(own)))
        elif bare:
            if m := _EDGE_NUMBER.search(line.rstrip("\n\x0c")):
                numbers.append((at + m.start(), at + m.end()))
            for m in pattern.finditer(line) if pattern else ():
                is_title = title and m.group().lower() == title.strip().lower()
                if not is_title:
                    rest = bare.replace(m.group(), "", 1)
                    if not _WORD.search(_EDGE_NUMBER.sub("", rest)) or m.end() >= len(line.rstrip("\n\x0c")) and line[max(0, m.start() - 1) : m.start()].isalpha():
                        heads.append((at + m.start(), at + m.end()))
                elif m.group() == bare or k == 0:
                    titles.append((at + m.start(), at + m.end(), k))
                elif m.end() >= len(line.rstrip("\n\x0c")) and _GLUED.search(line[: m.start()]) or m.start() == 0:
                    heads.append((at + m.start(), at + m.end()))
            if title and bare != title and len(bare) < 90 and not (pattern and pattern.search(line)) and _nearly(bare, title.strip()):
                titles.append((begin, begin + len(bare), k))
        after_number = bool(numbers) and numbers[-1][1] == begin + len(bare) if bare else after_number
        at += len(line)
    if not title:
        heads += _repeated_lines(text)
    elif numbers or heads or cut_words(text, False):  # of other texts, repeated lines may be headings
        heads += [(a, b) for a, b in _repeated_lines(text, 2) if not any(x < b and a < y for x, y in heads) and read_alike(text[a:b].strip()) != read_alike(title.strip())]
    if len(titles) + len(heads) > 1 and titles:  # the title itself stands once, before the text
        heads += [(a, b) for a, b, k in titles if k or len(titles) > 1]
    return sorted(heads), sorted(numbers)


def number_lines(text: str) -> list[tuple[int, int]]:
    """Spans of the lines that are page numbers and nothing else, whatever the width of the other lines."""
    found, at = [], 0
    for line in text.replace("\x0c", "\n").split("\n"):
        if len(line) <= 40 and _OWN_NUMBER.match(line):
            found.append((at, at + len(line)))
        at += len(line) + 1
    return found


def _word_before(text: str, end: int) -> str:
    """The letters that end at a place of a text."""
    begin = end
    while begin and text[begin - 1].isalpha():
        begin -= 1
    return text[begin:end]


def _cuts(text: str, block: bool) -> Iterator[tuple[str, str, int, int]]:
    """The parts of each word cut at the end of a line, and where the cut begins and ends; hyphens left hanging before a joining word are none."""
    for m in _CUT[block].finditer(text):
        a, b = _word_before(text, m.start()), _WORD.match(text, m.end()).group()
        if a and b.lower() not in _JOINERS and (b[0].islower() or a.isupper()):
            yield a, b, m.start(), m.end()


def cut_words(text: str, block: bool) -> list[tuple[str, str]]:
    """The two parts of each cut word."""
    return [(a, b) for a, b, _, _ in _cuts(text, block)]


def without(text: str, spans: list[tuple[int, int]], block: bool) -> str:
    """A text without its running heads and page numbers; what goes on behind them stands in the next line, or in a block after one space."""
    for a, b in sorted(set(spans), reverse=True):
        head, rest = text[:a].rstrip(" "), text[b:].lstrip(" ")
        if head[-1:] in ("\n", "\x0c", ""):
            text = head + (rest[1:] if rest[:1] in ("\n", "\x0c") else rest)
        else:
            text = head + (" " if block else "" if rest[:1] in ("\n", "\x0c", "") else "\n") + rest
    return text


def joined(text: str, block: bool, uncut: frozenset[str] | set[str] = frozenset()) -> str:
    """A text with its cut words whole; the compounds in `uncut` keep their hyphen."""
    out, at = [], 0
    for a, b, begin, end in _cuts(text, block):
        out += [text[at:begin], "-" if f"{a}-{b}".lower() in uncut else ""]
        at = end
    return "".join([*out, text[at:]]) if out else text


def mixed_words(text: str) -> set[str]:
    """Words that hold digits or bars, as misread letters would, in lower case; not codes, numbers with units or encoded data."""
    found: set[str] = set()
    if not _BESIDE_DIGIT.search(text):
        return found
    for m in _MIXED.finditer(text):
        w = m.group(1)
        odd = sum(c.isdigit() or c == "|" for c in w)
        if len(w) >= LEAST_LETTERS and 1 <= odd and 3 * odd <= len(w) and not re.search(r"[2347]", w) and not w[0].isdigit():
            found.add(w.lower())
    return found


def _letters_of(word: str) -> list[tuple[str, float]]:
    """What a mixed word may have been, with weights."""
    options = [("", 0.0)]
    for ch in word:
        reads = [(y, w) for x, y, w in CONFUSIONS if x == ch] if not ch.isalpha() else [(ch, 0.0)]
        options = [(a + y, c + w) for a, c in options for y, w in reads]
    return options


def lexicon(items: DataFrame) -> DataFrame:
    """(word, n, n_paged): the words, cut ones whole, and hyphenated compounds of all texts in lower case, counted in each batch before they are shuffled.

    n_paged counts those in texts whose lines are, or in blocks were, those of a page.
    """

    def work(cols: dict[str, list]) -> dict[str, list]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for t, block in zip(cols["text"], cols["block"]):
            low = joined(t, block).lower()
            own = counts[block or is_wrapped(t)]
            own.update(_LOWER.findall(low))
            own.update(f"{_word_before(low, m.start())}-{_WORD.match(low, m.end()).group()}" for m in _INNER_HYPHEN.finditer(low))
        kept = [w for w in counts[0].keys() | counts[1].keys() if len(w) >= LEAST_LETTERS]
        return {"word": kept, "n": [counts[0][w] + counts[1][w] for w in kept], "n_paged": [counts[1][w] for w in kept]}

    found = map_arrow(items.filter(F.length("text") > 0).select("text", "block"), "word string, n bigint, n_paged bigint", work)
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_paged").alias("n_paged"))


def corrections(words: DataFrame) -> DataFrame:
    """(noisy, fix, weight, n_fix): words that a confusion sets apart from one at least LEAST_RATIO times as frequent.

    Misreadings come from scanners, so at least half of a noisy word's occurrences have to be in texts with the lines of
    a page; a name that happens to resemble another word stands in all kinds of texts.
    """

    def keys(side: int) -> DataFrame:
        def work(cols: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("key", "pair", "word", "n")}
            for word, n in zip(cols["word"], cols["n"]):
                for p, pair in enumerate(CONFUSIONS):
                    piece = pair[side]
                    at = word.find(piece)
                    while at >= 0:
                        h = xxhash.xxh3_64_intdigest(f"{p}\n{word[:at]}\n{word[at + len(piece):]}")
                        for k, v in zip(out, (h - (1 << 63), p, word, n)):
                            out[k].append(v)
                        at = word.find(piece, at + 1)
            return out

        own = words.filter(~F.col("word").contains("-"))
        return map_arrow((own.filter(F.col("n") >= LEAST_COUNT) if side else own.filter(2 * F.col("n_paged") >= F.col("n"))).select("word", "n"), "key bigint, pair int, word string, n bigint", work)

    a, b = keys(0), keys(1).withColumnsRenamed({"word": "fix", "n": "n_fix", "pair": "pair_fix"})
    found = a.join(b, "key").filter((F.col("pair") == F.col("pair_fix")) & (F.col("n_fix") >= F.col("n") * LEAST_RATIO))
    weights = F.array(*(F.lit(w) for _, _, w in CONFUSIONS))
    return found.select(F.col("word").alias("noisy"), "fix", weights[F.col("pair")].alias("weight"), "n_fix").distinct()


BITS = 1 << 25  # of the map of noisy words: 4 MB at any scale; words that pass it wrongly fall out in the join


def _bit(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) % BITS


def _word_map(words: DataFrame, column: str) -> bytes:
    """The bit map of the words of a column, packed."""
    rows = map_arrow(words.select(column).distinct(), "bit bigint", lambda cols: {"bit": [_bit(w) for w in cols[column]]})
    maps = rows.groupBy(F.floor(F.col("bit") / 32_768).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(32_768))).alias("bits"))
    out = np.zeros((BITS // 32_768, 4_096), np.uint8)
    for r in maps.toLocalIterator():  # at most BITS / 32,768 rows
        out[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


class _Members(dict):
    """Word -> whether a packed bit map has it, kept for the words seen lately."""

    def __init__(self, packed: bytes):
        self.packed = packed

    def __missing__(self, word: str) -> bool:
        if len(self) >= 300_000:
            self.clear()
        b = _bit(word)
        found = self[word] = bool(self.packed[b >> 3] >> (b & 7) & 1)
        return found


PROBES = "rec_table string, rec_id bigint, kind string, probe string, fix string, weight double, beside string, inside boolean"


def probes(items: DataFrame, noisy: bytes) -> DataFrame:
    """What looks like noise in each record; words are to be held against the lexicon, but those with digits inside are sure.

    items: rec_table, rec_id, text, title, source, code, block.
    """
    packed = items.sparkSession.sparkContext.broadcast(noisy)

    def work(cols: dict[str, list]) -> dict[str, list]:
        rows: list[tuple] = []
        noisy_words = _Members(packed.value)
        for rec_table, rec_id, text, title, source, code, block in zip(*(cols[c] for c in ("rec_table", "rec_id", "text", "title", "source", "code", "block"))):
            key = (rec_table, rec_id)
            paged = block or is_wrapped(text)
            heads, numbers = page_parts(text, title, source, block, code) if paged else ([], number_lines(text))
            if heads:
                rows.append((*key, "running_head", None, None, None, None, None))
            if numbers:
                rows.append((*key, "page_number", None, None, None, None, None))
            text = without(text, [*heads, *numbers], block)  # they may stand between the parts of a cut word
            for a, b in set(cut_words(text, block)):
                rows.append((*key, "hyphenation", f"{a}-{b}".lower(), None, None, None, None))
            text = joined(text, block)
            for w in mixed_words(text):
                inside = paged and re.fullmatch(r"[^\W\d_]+(?:[0159|][^\W\d_]+){1,3}", w)
                for fix, weight in _letters_of(w):
                    rows.append((*key, "characters", w, fix, weight, None, bool(inside)))
            ws = _LOWER.findall(text.lower())
            for w in {w for w in set(ws) if len(w) >= LEAST_LETTERS and noisy_words[w]}:
                at = ws.index(w)
                rows.append((*key, "characters", w, None, None, ws[at - 1] if at else "", None))
        names = ("rec_table", "rec_id", "kind", "probe", "fix", "weight", "beside", "inside")
        return dict(zip(names, zip(*rows) if rows else [()] * len(names)))

    return map_arrow(items.filter(F.length("text") > 0).select("rec_table", "rec_id", "text", "title", "source", "code", "block"), PROBES, work)


def bigrams(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """(beside, fix, pairs): how often each wanted pair of neighbouring words stands in the corpus."""
    packed = items.sparkSession.sparkContext.broadcast(_word_map(wanted, "fix"))

    def work(cols: dict[str, list]) -> dict[str, list]:
        counts: Counter = Counter()
        members = _Members(packed.value)
        for t in cols["text"]:
            ws = _LOWER.findall(t.lower())
            counts.update((a, b) for a, b in zip(ws, ws[1:]) if members[b])
        return {"beside": [a for a, _ in counts], "fix": [b for _, b in counts], "n": list(counts.values())}

    counted = map_arrow(items.filter(F.length("text") > 0).select("text"), "beside string, fix string, n bigint", work)
    return counted.groupBy("beside", "fix").agg(F.sum("n").alias("pairs")).join(wanted, ["beside", "fix"], "left_semi")


def find_noise(items: DataFrame, context: bool = True) -> DataFrame:
    """(rec_table, rec_id, kind, noisy, fix): the noise of each record.

    items: rec_table, rec_id, text, title, source, code (the number of the file), block, which tells that the lines of the text
    are joined by spaces. Heads of other texts are told only if their lines have a page's width, all else in every text. Null and empty texts give no
    rows, repeated rows count once; a null title or source only takes the heads away that would be told by it. noisy
    and fix are null for heads and page numbers; for a cut word they are the hyphenated and the joined form. context
    counts the neighbours of ambiguous words in a further pass over the texts, to pick among several fixes; without it the
    same words are found, by weight and frequency alone.
    """
    words = cut(lexicon(items))
    fixes = cut(corrections(words))
    found = cut(probes(items, _word_map(fixes, "noisy")))
    none = F.lit(None).cast("string")
    shape = found.filter(F.col("kind").isin("running_head", "page_number")).select("rec_table", "rec_id", "kind", none.alias("noisy"), none.alias("fix"))
    # A compound keeps its hyphen if it is written so more often than as one word.
    hyphened = words.filter(F.col("word").contains("-") & (F.col("n") >= 3)).select(F.col("word").alias("probe"), F.regexp_replace("word", "-", "").alias("word"), F.col("n").alias("n_hyphened"))
    compounds = hyphened.join(words, "word", "left").filter(F.col("n_hyphened") > F.coalesce("n", F.lit(0))).select("probe")
    hyphens = found.filter("kind = 'hyphenation'").join(compounds, "probe", "left_anti").select("rec_table", "rec_id", "kind", F.col("probe").alias("noisy"), F.regexp_replace("probe", "-", "").alias("fix"))
    known = found.filter("kind = 'characters' and fix is not null").join(words.select(F.col("word").alias("fix"), "n"), "fix", "left")
    mixed = known.filter(F.col("inside") | (F.col("n") >= LEAST_COUNT)).select("rec_table", "rec_id", "kind", F.col("probe").alias("noisy"), "fix", "weight", F.coalesce("n", F.lit(0)).alias("n"), "beside")
    plain = found.filter("kind = 'characters' and fix is null").drop("fix", "weight").join(fixes, F.col("probe") == F.col("noisy")).select("rec_table", "rec_id", "kind", "noisy", "fix", "weight", F.col("n_fix").alias("n"), "beside")
    options = mixed.unionByName(plain).withColumn("pairs", F.lit(0).cast("bigint"))
    by_word = Window.partitionBy("rec_table", "rec_id", "noisy")
    if context:
        options = cut(options.drop("pairs"))
        several = options.filter(F.col("beside") != "").withColumn("others", F.count(F.lit(1)).over(by_word)).filter("others > 1")
        options = options.join(bigrams(items, several.select("beside", "fix").distinct()), ["beside", "fix"], "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    # Of several fixes one that the lexicon knows comes first, then one seen after the word before, then the likelier confusion, then the more frequent word.
    order = by_word.orderBy(F.col("n") < LEAST_COUNT, F.col("pairs") == 0, "weight", F.desc("pairs"), F.desc("n"), "fix")
    one = options.withColumn("best", F.row_number().over(order)).filter("best = 1")
    return shape.unionByName(hyphens).unionByName(one.select("rec_table", "rec_id", "kind", "noisy", "fix")).distinct()


def repaired(text: str, title: str | None, source: str | None, block: bool, code: str | None, fixes: dict[str, str], uncut: set[str]) -> str:
    """A text without heads and page numbers, its cut words joined but for the compounds in `uncut`, its misread words
    restored, and its lines run on within paragraphs. Where the lines aren't those of a page they stay, but for cut words and page numbers."""
    scanned = block or is_wrapped(text)
    heads, numbers = page_parts(text, title, source, block, code) if scanned else ([], number_lines(text))
    text = without(text, [*heads, *numbers], block)
    text = re.sub(r"\n[ \t]*\n?\x0c\s*|\x0c\s*", "\n", text)

    text = joined(text, block, uncut)
    if scanned and not block:
        text = "\n\n".join(" ".join(p.split("\n")) for p in re.split(r"\n[ \t]*\n", text))

    def restore(m: re.Match) -> str:
        fix = fixes.get(m.group().lower())
        if fix is None:
            return m.group()
        return fix.upper() if m.group().isupper() else fix[0].upper() + fix[1:] if m.group()[0].isupper() else fix

    if fixes:
        text = re.sub(r"[^\W_](?:[^\W_]|\|)*", restore, text)
    return re.sub(r"[ \t]{2,}", " ", text).strip()


REPAIRED = "rec_table string, rec_id bigint, restored string"


def repair_scans(items: DataFrame, noise: DataFrame) -> DataFrame:
    """(rec_table, rec_id, restored): the records that find_noise reports, as continuous text.

    Only those records are shuffled with their texts. Repeated rows give one; a record with several texts gives each.
    """
    known = noise.groupBy("rec_table", "rec_id").agg(
        F.collect_set(F.when(F.col("kind") == "characters", F.struct("noisy", "fix"))).alias("fixes"), F.collect_set(F.when(F.col("kind") == "hyphenation", F.col("noisy"))).alias("cut")
    )
    rows = items.filter(F.length("text") > 0).select("rec_table", "rec_id", "text", "title", "source", "code", "block").join(known, ["rec_table", "rec_id"])

    def work(cols: dict[str, list]) -> dict[str, list]:
        out = []
        for text, title, source, code, block, fixes, cut_here in zip(*(cols[c] for c in ("text", "title", "source", "code", "block", "fixes", "cut"))):
            every = {f"{a}-{b}".lower() for a, b in cut_words(text, block)}
            out.append(repaired(text, title, source, block, code, {x["noisy"]: x["fix"] for x in fixes if x["noisy"]}, every - set(cut_here)))
        return {"rec_table": cols["rec_table"], "rec_id": cols["rec_id"], "restored": out}

    return map_arrow(rows, REPAIRED, work).distinct()

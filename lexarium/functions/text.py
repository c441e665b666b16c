"""Text expressions. All are built-in expressions, so they stay in whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import STOPWORDS

#: White space, spelled out so that every regular-expression dialect reads it alike.
SPACE = r"[ \t\n\r\f]"
LETTERS = r"[\p{L}\p{N}_]"


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    """Whether a text is null, empty or white space only."""
    return F.coalesce(strip(text) == "", F.lit(True))


def token_list(text: Column) -> Column:
    """The white-space separated tokens of a text in lower case, repeats included; null gives an empty list."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"{SPACE}+"), lambda x: x != "")


def tokens(text: Column) -> Column:
    """The distinct white-space separated tokens of a text in lower case."""
    return F.array_distinct(token_list(text))


def words(text: Column) -> Column:
    """The words of a text in lower case, repeats included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({LETTERS}+)"), F.lit(1))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, rf"\n{SPACE}*\n", -1), strip), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Pieces up to each full stop, question or exclamation mark, and the rest, stripped, without empty ones."""
    cut = F.regexp_extract_all(text, F.lit(r"([^.!?]*[.!?]|[^.!?]+$)"), F.lit(1))
    return F.filter(F.transform(cut, strip), lambda x: x != "")


def pages(text: Column) -> Column:
    """Pieces between form feeds that aren't blank."""
    return F.filter(F.split(text, "\f", -1), lambda x: strip(x) != "")


def stride_chunks(text: Column, size: int, overlap: int) -> Column:
    """Windows of size characters at every size - overlap; a text that fits is one chunk, an empty one none."""
    check_window(size, overlap)
    step = size - overlap
    n = F.length(text)
    windows = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size)))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.array().cast("array<string>")).when(n <= size, F.array(text)).otherwise(windows)


def check_window(size: int, overlap: int) -> None:
    """Sizes must be positive, overlaps at least 0 and less than the size."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if overlap < 0:
        raise ValueError("chunk overlap must not be negative")
    if overlap >= size:
        raise ValueError("chunk overlap must be less than the chunk size")


def token_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of size tokens at every size - overlap, joined by spaces."""
    check_window(size, overlap)
    toks = F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")
    n = F.size(toks)
    windows = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)), lambda i: F.array_join(F.slice(toks, i + 1, F.lit(size)), " "))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.array().cast("array<string>")).otherwise(windows)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap_share(of: Column, within: Column) -> Column:
    """The share of the tokens of one set that another has."""
    return F.size(F.array_intersect(of, within)) / F.size(of)


def entities(text: Column, languages: Sequence[str] = ("en",)) -> Column:
    """Key terms: words of four and more letters, digits, hyphens or underscores that aren't stop words, and standard
    references of the original text without spaces, in lower case and in order."""
    stop = F.array(*(F.lit(w) for lang in languages for w in STOPWORDS.get(lang, ()))) if any(STOPWORDS.get(x) for x in languages) else F.array().cast("array<string>")
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_-]+")
    long = F.filter(parts, lambda x: x.rlike("^[a-zäöüß0-9_-]{4,}$"))
    refs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:^|[^\p{L}\p{N}_])((?:DIN|EN|ISO|IEC|CEN|TR)[ \t\n\r\f]*[-_]?[ \t\n\r\f]*[0-9]+(?:[-_][0-9]+)*)"), F.lit(1))
    refs = F.transform(refs, lambda x: F.lower(F.replace(x, F.lit(" "), F.lit(""))))
    return F.array_sort(F.array_distinct(F.concat(F.array_except(long, stop), refs)))


def language_vote(text: Column) -> Column:
    """en or de, by the number of its stop words among the tokens; null if there is none of either."""
    toks = token_list(text)

    def votes(lang: str) -> Column:
        own = F.array(*(F.lit(w) for w in STOPWORDS[lang]))
        return F.size(F.filter(toks, lambda x: F.array_contains(own, x)))

    return F.when(votes("de") > votes("en"), "de").when(votes("en") > 0, "en")


_W = r"[\p{L}\p{N}_]"
_EDGE = rf"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))"
#: Patterns of what scanned text tends to hold, each match one likely error.
ERROR_PATTERNS = (
    rf"{_EDGE}I[^a-zA-Z\s\p{{Z}}]",  # I before what is no letter
    r"[a-z][A-Z]",  # a capital inside a word
    r"[0-9][a-zA-Z]|[a-zA-Z][0-9]",  # letters beside digits
    r"vv|rn",
    r"l1|11",
    rf"([^\p{{L}}\p{{N}}_\s\p{{Z}}])\1{{2,}}",  # a sign three times and more
    rf"{_EDGE}{_W}*[^a-zA-Z0-9\s\p{{Z}}.,;:!?-]{_W}*{_EDGE}",  # a word with an unusual character
)


def error_rate(text: Column) -> Column:
    """Likely scanning errors per word, 1 at most; 0 without words."""
    text = F.coalesce(text, F.lit(""))
    n = F.size(words(text))
    errors = sum((F.regexp_count(text, F.lit(p)) for p in ERROR_PATTERNS), F.lit(0))
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), errors / n))


def is_heading(text: Column) -> Column:
    """Short, without end punctuation, and in capitals, numbered, or with more than 0.7 of the words capitalised."""
    t = strip(text)
    ws = F.filter(F.split(t, f"{SPACE}+"), lambda x: x != "")
    capital = F.size(F.filter(ws, lambda x: x.rlike(r"^\p{Lu}")))
    shout = t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}")
    return (F.length(t) <= 100) & ~t.rlike("[.,;:!]$") & (shout | t.rlike("^[0-9]+[.]") | ((F.size(ws) > 0) & (capital > F.size(ws) * 0.7)))


def is_list_item(text: Column) -> Column:
    """Whether the first line begins with a bullet, a number or a letter with a mark."""
    return strip(F.split(text, "\n")[0]).rlike("^([*•◦▪▫○●-]|[0-9]+[.)]|[a-z][.)])")


def heading_level(text: Column) -> Column:
    """4 for three numbers, 3 for two, 2 for one or capitals, else 3."""
    t = strip(text)
    shout = t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}")
    return F.when(t.rlike("^[0-9]+[.][0-9]+[.][0-9]+"), 4).when(t.rlike("^[0-9]+[.][0-9]+"), 3).when(t.rlike("^[0-9]+[.]") | shout, 2).otherwise(3)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def truncate(text: Column, limit: int, back: float, suffix: str) -> Column:
    """A text cut at limit characters, back at its last full stop if that lies beyond back * limit, with a suffix; whole if it fits."""
    head = F.substring(text, 1, limit)
    stop = F.length(head) - F.instr(F.reverse(head), ".") + 1
    kept = F.when((F.instr(head, ".") > 0) & (stop - 1 > limit * back), F.substring(head, F.lit(1), stop)).otherwise(head)
    return F.when(F.length(text) > limit, F.concat(kept, F.lit(suffix))).otherwise(text)

"""Missing or wrong document language labels (problem 2).

Sparse multinomial logistic regression on TF-IDF character n-grams, trained with follow-the-regularised-leader and
elastic-net penalties on a bounded sample of labelled documents, with temperature calibration on held-out segments.
Letters are numbered below 64, so that a trigram is an index into one table and a text's score a sum of its rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_arrow
from .stuffing import is_stuffed

LANGUAGES = ("en", "de", "fr", "es", "nl")
#: Names of the languages, without regions; fixed values after ISO 639.
NAMES = {
    "en": "en", "eng": "en", "english": "en", "englisch": "en", "anglais": "en", "inglés": "en", "engels": "en",
    "de": "de", "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "allemand": "de", "alemán": "de", "duits": "de",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "francais": "fr", "französisch": "fr", "francés": "fr", "frans": "fr",
    "es": "es", "spa": "es", "spanish": "es", "español": "es", "espanol": "es", "castellano": "es", "spanisch": "es", "espagnol": "es", "spaans": "es",
    "nl": "nl", "nld": "nl", "dut": "nl", "dutch": "nl", "nederlands": "nl", "niederländisch": "nl", "néerlandais": "nl", "neerlandés": "nl", "flemish": "nl", "vlaams": "nl",
}

_CHARS = "abcdefghijklmnopqrstuvwxyzäöüßéèêëàâîïôûùçñáíóúœÿæ"
_CODE = np.full(0x3000, 60, np.uint32)  # other letters
for _c in range(0x3000):
    if not chr(_c).isalpha():
        _CODE[_c] = 0
for _k, _c in enumerate(_CHARS):
    _CODE[ord(_c)] = _k + 1
TABLE = 1 << 18


def label_language(label: str | None) -> str | None:
    """The language that a label names by whatever code, name or region; None if it names none of the five."""
    parts = re.split(r"[^\w]+|_", (label or "").strip().lower())
    return NAMES.get(parts[0]) if parts else None


#: Runs that may be no words of any language but encoded data or long links; they are if a tenth of them is no letters.
_BLOB = re.compile(r"\S{41,}")


def _without_blob(m: re.Match) -> str:
    return " " if 10 * sum(map(str.isalpha, m.group())) < 9 * len(m.group()) else m.group()


def trigrams(segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigram numbers of all segments one after the other, and where each begins; each segment has at least one."""
    padded = [f"  {_BLOB.sub(_without_blob, s)}  ".lower() for s in segments]
    joined, starts = "".join(padded), np.cumsum([0, *map(len, padded)])
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = _CODE[np.minimum(raw, 0x2FFF)]
    grams = np.zeros(len(code), np.uint32)
    grams[:-2] = (code[:-2] << 12) | (code[1:-1] << 6) | code[2:]
    return grams, starts


@dataclass
class Model:
    """table: the scores that a trigram adds for each language; the score of a text is their mean over its letters."""

    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def scores(self, segments: list[str], block_chars: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores, and the number of trigrams with letters, of each segment; worked off in blocks of about block_chars."""
        out = [(np.zeros((0, len(LANGUAGES)), np.float32), np.zeros(0, np.int64))]
        begin = size = 0
        for k, segment in enumerate(segments, 1):
            size += len(segment)
            if size >= block_chars or k == len(segments):
                out.append(self._scores(segments[begin:k]))
                begin, size = k, 0
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def _scores(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        grams, starts = trigrams(segments)
        sums = np.add.reduceat(self.table[grams], starts[:-1], axis=0)
        n = np.add.reduceat((grams != 0).astype(np.int64), starts[:-1])
        return sums / np.maximum(n, 1)[:, None] + self.bias, n

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of the languages."""
        x = scores / self.temperature
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)


def _segments(text: str) -> list[str]:
    return [s for s in text.split("\n\n") if sum(map(str.isalpha, s)) >= 40]


def train(samples: list[tuple[str, str]], min_df: int = 3, epochs: int = 3, batch: int = 64, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-4) -> Model:
    """Fit on (text, language) samples; every tenth text is held out for the temperature.

    A first fit rules out the training segments that contradict their label, since some labels are wrong and some
    texts mixed; the second fit is on the rest.
    """
    texts = [(s, LANGUAGES.index(lang), k % 10 == 9) for k, (t, lang) in enumerate(samples) for s in _segments(t)]
    if not texts:
        return Model(np.zeros((TABLE, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES)))
    grams, starts = trigrams([t[0] for t in texts])
    y, held = np.array([t[1] for t in texts]), np.array([t[2] for t in texts])
    rows = [np.unique(grams[a:b][grams[a:b] != 0], return_counts=True) for a, b in zip(starts, starts[1:])]
    df = np.bincount(np.concatenate([g for g, _ in rows]), minlength=TABLE)
    known = np.flatnonzero(df >= min_df)
    compact = np.full(TABLE, -1)
    compact[known] = np.arange(len(known))
    idf = np.log(len(rows) / df[known])
    data = []
    for g, c in rows:
        at = compact[g]
        ok = at >= 0
        data.append((at[ok], c[ok] / max(1, c.sum()) * idf[at[ok]]))
    use = ~held
    for _ in range(2):
        w, bias = _ftrl(data, y, np.flatnonzero(use), len(known), epochs, batch, alpha, beta, l1, l2)
        scores = np.array([v @ w[at] + bias for at, v in data])
        use = ~held & (scores.argmax(axis=1) == y)
    table = np.zeros((TABLE, len(LANGUAGES)), np.float32)
    table[known] = w * idf[:, None]
    model = Model(table, bias.astype(np.float32))
    check = np.flatnonzero(held) if held.any() else np.arange(len(y))
    model.temperature = _temperature(scores[check], y[check], float((scores.argmax(axis=1) != y).mean()))
    return model


def _ftrl(data: list, y: np.ndarray, order: np.ndarray, d: int, epochs: int, batch: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate FTRL-proximal over mini-batches; the last row of the state is the bias, without penalty."""
    k = len(LANGUAGES)
    z, n = np.zeros((d + 1, k)), np.zeros((d + 1, k))
    pen1, pen2 = np.full((d + 1, 1), l1), np.full((d + 1, 1), l2)
    pen1[d] = pen2[d] = 0
    rng = np.random.default_rng(7)
    w = np.zeros((d + 1, k))
    for _ in range(epochs):
        order = rng.permutation(order)
        for b in range(0, len(order), batch):
            rows = order[b : b + batch]
            at = np.concatenate([np.append(data[r][0], d) for r in rows])
            v = np.concatenate([np.append(data[r][1], 1.0) for r in rows])
            of = np.repeat(np.arange(len(rows)), [len(data[r][0]) + 1 for r in rows])
            s = np.zeros((len(rows), k))
            for c in range(k):
                s[:, c] = np.bincount(of, v * w[at, c], len(rows))
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            g = np.stack([np.bincount(at, v * p[of, c], d + 1) for c in range(k)], axis=1)
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / alpha
            z += g - sigma * w
            n += g * g
            w = np.where(np.abs(z) <= pen1, 0.0, -(z - np.sign(z) * pen1) / ((beta + np.sqrt(n)) / alpha + pen2))
    return w[:d], w[d]


def _temperature(scores: np.ndarray, y: np.ndarray, noise: float) -> float:
    """The temperature of least held-out log loss, on a grid, where the share `noise` of the labels is arbitrary."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        x = np.exp((scores - scores.max(axis=1, keepdims=True)) / t)
        p = x[np.arange(len(y)), y] / x.sum(axis=1)
        return float(-np.log((1 - noise) * p + noise / len(LANGUAGES) + 1e-12).mean())

    return min((float(t) for t in np.geomspace(0.2, 20, 41)), key=loss)


def fit(documents: DataFrame, sample_docs: int = 3000) -> Model:
    """Train on at most sample_docs labelled documents, those of the least hashes of their ids.

    Their share of all labelled documents is known before they are read, so that few more rows than are used leave the
    scan, whatever the number of documents. Without any text the model is empty; texts without any label that names
    one of the languages are an error.
    """
    with_text = documents.filter(F.length("text") > 0)
    labelled = with_text.filter(F.col("lang").isNotNull())
    n, all_docs = with_text.agg(F.count("lang"), F.count(F.lit(1))).first()
    if not all_docs:
        return train([])
    rows = labelled.select("doc_id", "text", "lang", F.xxhash64("doc_id").alias("h")).filter(F.col("h") <= least_hash(1.2 * sample_docs / max(1, n)))
    rows = rows.orderBy("h", "doc_id", "text", "lang").limit(sample_docs).collect()  # at most sample_docs of each task
    samples = [(r["text"], label_language(r["lang"])) for r in rows]
    samples = [(t, lang) for t, lang in samples if lang and not is_stuffed(t)]
    if not samples:
        raise ValueError("no document with a label that names one of the languages to train on")
    return train(samples)


def least_hash(share: float) -> int:
    """The bound that a share of all signed 64-bit hashes doesn't exceed."""
    return -(1 << 63) + max(0, min((1 << 64) - 1, int(share * 2.0**64)))


_WORDS = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?…][\"”’»)\]]*(?:\s|$)")
_REFERENCE = re.compile(r"^\s*(?:\[\d+\]|.*https?://)", re.MULTILINE)
_PROGRAM = re.compile(r"^\s*(?:```|def |class \w+[:(]|import |return |SELECT |#include|function |var |let |const )|[{};]\s*$|\w+\(\w*(?:, ?\w+(?:=\w+)?)*\)|^\s*\w+ = \S", re.MULTILINE)


def is_prose(paragraph: str, long: int = 20, short: int = 8) -> bool:
    """Whether a paragraph is prose, not a heading, a byline, code or a list of references.

    Prose has at least `long` words, or `short` ones and the end of a sentence.
    """
    n = len(_WORDS.findall(paragraph))
    if n < short or n < long and not _END.search(paragraph):
        return False
    lines = paragraph.count("\n") + 1
    return not _PROGRAM.search(paragraph) and 2 * len(_REFERENCE.findall(paragraph)) < lines


ASSIGNED = "doc_id bigint, seg_no int, lang string, confidence double, label string, mislabelled boolean"


def assign_languages(documents: DataFrame, model: Model, min_confidence: float = 0.8, cases_only: bool = False) -> DataFrame:
    """The language of each document (seg_no -1) and of each prose paragraph in another language than most of its text.

    documents: doc_id, text, lang. label is the language that the given label names, null if none; mislabelled tells
    whether it differs from the assigned one, null for paragraphs. Documents without letters (null, blank, digits) give no
    rows; equal texts get equal rows. confidence is the calibrated probability, for documents weighted by text.
    cases_only leaves out the documents whose label is right, and pages stuffed with keywords, which have no language.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def work(cols: dict[str, list]) -> dict[str, list]:
        m = shared.value
        parts = [t.split("\n\n") for t in cols["text"]]
        flat = [p for ps in parts for p in ps]
        scores, n = m.scores(flat)
        prob = m.probabilities(scores)
        top = prob.argmax(axis=1)
        rows, begin = [], 0
        for doc_id, label, ps in zip(cols["doc_id"], cols["lang"], parts):
            end = begin + len(ps)
            size, best = n[begin:end], top[begin:end]
            if size.sum():
                weight = (prob[begin:end] * size[:, None]).sum(axis=0)
                main = int(weight.argmax())
                named = label_language(label)
                own = [] if cases_only and named == LANGUAGES[main] else [(doc_id, -1, LANGUAGES[main], float(weight[main] / size.sum()), named, named != LANGUAGES[main])]
                for k in np.flatnonzero((best != main) & (size > 0)):
                    p = float(prob[begin + k, best[k]])
                    if p >= min_confidence and is_prose(ps[k]):
                        own.append((doc_id, int(k), LANGUAGES[best[k]], p, None, None))
                if not (cases_only and own and is_stuffed("\n\n".join(ps))):
                    rows += own
            begin = end
        return dict(zip(("doc_id", "seg_no", "lang", "confidence", "label", "mislabelled"), zip(*rows) if rows else [()] * 6))

    return map_arrow(documents.filter(F.length("text") > 0).select("doc_id", "lang", "text"), ASSIGNED, work)

"""What the operators once left out: pairs at the threshold, unwrapped scans, short pages."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarium.llm import neardup, scans, stuffing
from lexarium.llm.base import words


def jaccard(a, b, size):
    x, y = ({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} for w in (words(a), words(b)))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7])
def test_p4_finds_every_pair_at_the_threshold(spark, threshold):
    """Pairs barely above and below the threshold; none may be lost by chance."""
    rng = random.Random(11)
    texts = []
    for k in range(150):
        ws = [f"w{rng.randrange(4000)}" for _ in range(120)]
        tail = round(120 * (1 - threshold) / (1 + threshold)) + k % 7 - 3
        texts += [" ".join(ws), " ".join(ws[: 120 - tail] + [f"v{rng.randrange(4000)}" for _ in range(tail)])]
    items = spark.createDataFrame([("documents", k, t) for k, t in enumerate(texts)], "rec_table string, rec_id long, text string")
    _, links = neardup.near_duplicates(items, threshold, 3, 20)
    want = {(a, b) for a, b in combinations(range(len(texts)), 2) if a // 2 == b // 2 and jaccard(texts[a], texts[b], 3) >= threshold}
    assert 30 < len(want) < 150
    assert {(r.rep_a, r.rep_b) for r in links.collect()} == want


def test_p9_short_pages_are_judged(spark):
    links = " ".join(f"https://shop{k}.example/a" for k in range(3))
    rows = [(1, links), (2, "#valves #pumps #sensors #cheap #order"), (3, "Valve closed"), (4, "See https://docs.example/a for the notes that we keep on this"), (5, "valve valve"), (6, "--"), (7, "Acme pump 3000; Acme pump 4000; Acme pump 5000")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in stuffing.stuffed_pages(frame).collect()} == {1, 2, 7} == {k for k, t in rows if stuffing.is_stuffed(t)}


def test_p6_cut_words_and_numbers_outside_of_pages(spark):
    long = "One paragraph that isn't wrapped " * 8
    rows = [(1, f"{long}\nand a pres-\nsure line\nPage 3 of 9\nthe end"), (2, "a very short mod-\nule"), (3, f"{long}\n- 7 -"), (4, long + "\n- first\n- second")]
    items = spark.createDataFrame([("documents", k, t, None, None, None, False) for k, t in rows], "rec_table string, rec_id long, text string, title string, source string, code string, block boolean")
    noise = scans.find_noise(items, context=False)
    assert {(r.rec_id, r.kind) for r in noise.collect()} == {(1, "hyphenation"), (1, "page_number"), (2, "hyphenation"), (3, "page_number")}
    fixed = {r.rec_id: r.restored for r in scans.repair_scans(items, noise).collect()}
    assert "and a pressure line\nthe end" in fixed[1] and "Page 3" not in fixed[1] and fixed[2] == "a very short module" and "7" not in fixed[3]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.8, 0.95])
def test_p4_plans_miss_few_pairs(threshold):
    """Signatures and sketches of random pairs at the threshold, in every band of up to 600 shingles."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 12, 20, 45, 90, 180, 400, 600):
        for _ in range(20):
            d = int(2 * n * (1 - threshold) / (1 + threshold))
            common = n - (d + 1) // 2
            pool = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n : n + d - (n - common)]]))
            if len(np.intersect1d(a, b)) < threshold * len(np.union1d(a, b)):
                continue
            (own, found, low) = neardup.sign([a, b], threshold)
            rows = [{(int(x), int(y)) for k, x, y in zip(own, found, low) if k == side} for side in (0, 1)]
            assert any(x == y and (p | q) % 2 and (((p ^ q) % 2**64) >> 1).bit_count() <= neardup.most_apart(threshold) for x, p in rows[0] for y, q in rows[1])


def test_p4_many_copies_are_sorted_out_by_a_shuffle(spark):
    texts = [" ".join(f"w{k}" for k in range(a, a + 40)) for a in (0, 0, 0, 1, 1, 500)]
    items = spark.createDataFrame([("documents", k, t) for k, t in enumerate(texts)], "rec_table string, rec_id long, text string")
    found = neardup.digests(items, 3, 20)
    classes = found.groupBy("rec_table", "set1", "set2").agg(F.min("rec_id").alias("rep_id"))
    copies = found.filter("rec_id in (1, 2, 4)").select("rec_table", "rec_id")
    few, many = (neardup.representatives_signed(items, classes, copies, 0.7, 3, 20, n) for n in (10, 2))
    assert {r.rec_id for r in few.collect()} == {0, 3, 5}
    assert sorted(few.collect()) == sorted(many.collect())


def test_p4_threshold_must_be_a_share(spark):
    with pytest.raises(ValueError):
        neardup.near_duplicates(spark.createDataFrame([], "rec_table string, rec_id long, text string"), 0.0)


def test_p9_repeats_across_a_long_page(spark):
    """A list of distinct words given twice is stuffing, however long it is."""
    rng = random.Random(9)
    names = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(11_500)]
    once, twice = " ".join(names), " ".join(names + names)
    frame = spark.createDataFrame([(1, twice), (2, once), (3, " ".join(names[:5_000] * 2))], "doc_id long, text string")
    assert {r.doc_id for r in stuffing.stuffed_pages(frame).collect()} == {1, 3}


@pytest.mark.parametrize("seed", range(30))
def test_p9_words_against_brute_force(seed):
    rng = random.Random(seed)
    found = [rng.choice(["a", "bb", "ccc", "dddddd"]) for _ in range(rng.randint(1, 25))]
    want = [False] * len(found)
    for i in range(len(found)):
        for j in range(i + 1, len(found) + 1):
            run = found[i:j]
            if len(" ".join(run)) >= 6 and sum(found[k : k + len(run)] == run for k in range(len(found))) > 1:
                want[i:j] = [True] * (j - i)
    assert stuffing.repeated_words(found, 6) == want


def noise_of(spark, rows):
    items = spark.createDataFrame(rows, "rec_table string, rec_id long, text string, title string, source string, code string, block boolean")
    return {(r.rec_id, r.kind, r.noisy) for r in scans.find_noise(items).collect()}


CLEAN = "the pressure modules follow the archive sensors carefully and return"


def test_p6_cut_words_around_heads_and_numbers(spark):
    rows = [("text_blocks", 1, "the pres- FELURIX · NRV 3550-9 sure modules", "Pump records: late Felurix", "www.felurix.example", "NRV 1-1", True), ("text_blocks", 2, "the archi- S. 50 ves return", None, None, None, True)]
    rows += [("text_blocks", 3, "die Ein- - 7 - und Ausgänge", None, None, None, True)]
    assert {(r, k) for r, k, _ in noise_of(spark, rows)} == {(1, "running_head"), (1, "hyphenation"), (2, "page_number"), (2, "hyphenation"), (3, "page_number")}


def test_p6_compounds_are_told_by_their_frequency(spark):
    """Where line ends are lost some cut words look like compounds; they are none while the whole word is more frequent."""
    rows = [("documents", k, CLEAN, None, None, None, False) for k in range(30)] + [("documents", 100 + k, "the pres-sure fell", None, None, None, False) for k in range(4)]
    rows += [("documents", 200 + k, "a post-shift check", None, None, None, False) for k in range(9)]
    rows += [("text_blocks", 1, "the pres- sure fell", None, None, None, True), ("text_blocks", 2, "a post- shift check", None, None, None, True)]
    assert noise_of(spark, rows) == {(1, "hyphenation", "pres-sure")}


def test_p6_names_in_all_kinds_of_texts_are_no_misreadings(spark):
    rows = [("documents", k, "the walls of Mensen stand bare now and then", None, None, None, False) for k in range(40)]
    rows += [("documents", 100 + k, "the walls of Merisen stand bare", None, None, None, False) for k in range(3)]
    rows += [("text_blocks", 1, "the walls of Merisen stand bare", None, None, None, True), ("text_blocks", 2, "the wallc stand bare", None, None, None, True), ("text_blocks", 3, "the walls sfand", None, None, None, True)]
    assert noise_of(spark, rows) == {(3, "characters", "sfand")}


def test_p6_misread_words_outside_of_pages(spark):
    rows = [("documents", k, CLEAN, None, None, None, False) for k in range(30)] + [("text_blocks", 1, "the prcssure falls", None, None, None, True), ("documents", 99, "A short note on prcssure.", None, None, None, False)]
    assert noise_of(spark, rows) == {(1, "characters", "prcssure"), (99, "characters", "prcssure")}


PAGE = "The archive sensors were kept in the hall and the readers\nwere sent back to the drafts, as the notes on winter say.\n{head}\nThe frames are kept in the same hall, where two people\ninspect them before the limits are reached once more.\n"


def test_p6_heads_by_repetition_and_misread():
    def heads(text, title, source):
        return [text[a:b] for a, b in scans.page_parts(text, title, source, False)[0]]

    one, two = PAGE.format(head="Quinaster NRV 6397-1"), PAGE.format(head="Quiriaster NRV 6397-1")
    assert heads(one + two, "Pump records: late Felurix", "wiki.quinaster.example") == ["Quinaster NRV 6397-1", "Quiriaster NRV 6397-1"]
    assert heads(two, "Pump records: late Felurix", None) == ["Quiriaster NRV 6397-1"]
    more = "Nobody knew whether the walls of the other building\nwould stand until the spring, so they were propped up\nwith beams that had been lying in the yard for years.\n"
    assert heads(PAGE.format(head="Late sensor reports") + "S. 4\nLate scnsor reports\n" + more, "Pump records: late Felurix", None) == ["Late sensor reports", "Late scnsor reports"]
    assert heads(PAGE.format(head="Late sensor reports") + "Other reports\n" + more, "Pump records: late Felurix", None) == []
    assert heads("S. 4\nPump records: late Felurix\n" + PAGE.format(head="and so on"), "Pump records: late Felurix", None) == ["Pump records: late Felurix"]


def test_p9_repeats_within_words_count_in_pages_of_any_length(spark):
    """Keywords joined with ever new words, just below and beyond 100,000 characters and well beyond."""
    rng = random.Random(5)
    pages = [" ".join(rng.choice(["billig", "pumpen", "ventil", "sensor"]) + "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(n)) for n in (6_500, 7_000, 20_000)]
    assert len(pages[0]) < 100_000 < len(pages[1])
    got = {r.doc_id: r for r in stuffing.score_pages(spark.createDataFrame(list(enumerate(pages)), "doc_id long, text string")).collect()}
    assert [(got[k].stuffed, got[k].stuffing_words) for k in range(3)] == [(True, 6_500), (True, 7_000), (True, 20_000)]
    assert all(0.8 < got[k].repeated_share < 0.9 for k in range(3))


@pytest.mark.parametrize("n", [2_000, 11_000, 11_500, 60_000])
def test_p9_distinct_words_given_once_are_no_repeats_at_any_length(n):
    """Parts of words recur by chance the more the longer a page is; that may not make it stuffed."""
    rng = random.Random(9)
    names = list(dict.fromkeys("".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(n)))
    assert not stuffing.is_stuffed(" ".join(names)) and stuffing.is_stuffed(" ".join(names * 2))


@pytest.mark.parametrize("n", [8, 9, 10, 11, 40])
def test_p9_one_rule_on_both_sides_of_twenty_words(n):
    """A list given twice, and a short keyword between ever new words."""
    rng = random.Random(n)
    names = ["".join(rng.sample("bcdfghklmnprstvz", 7)) for _ in range(n)]
    assert stuffing.is_stuffed(", ".join(names * 2)) and not stuffing.is_stuffed(", ".join(names))
    assert stuffing.is_stuffed("nut " + " ".join(f"{w} nut" for w in names))


@pytest.mark.parametrize("alphabet", ["ab", "a é漢😀", "".join(map(chr, range(0x4E00, 0x9000))) + "😀"])
def test_p9_cover_of_whole_texts_against_counted_substrings(alphabet):
    """Also with so many characters that six of them don't fit a number."""
    rng = random.Random(7)
    text = "".join(rng.choice(alphabet) for _ in range(3_000))
    text += text[500:900] + "".join(rng.choice(alphabet) for _ in range(500))
    times = Counter(text[k : k + 6] for k in range(len(text) - 5))
    want = [any(times[text[j : j + 6]] > 1 for j in range(max(0, k - 5), min(k, len(text) - 6) + 1)) for k in range(len(text))]
    assert stuffing.repeated_cover(text, 6) == want and any(want)
    near = [any(t in text[max(0, k - 50) : k + 5] or t in text[k + 1 : k + 56] for t in [text[k : k + 6]]) for k in range(len(text) - 5)]
    assert stuffing.repeated_cover(text, 6, 50) == [any(near[max(0, k - 5) : k + 1]) for k in range(len(text))]

"""Each operator against brute force, round trips or planted cases, and on nulls, blanks, repeats, long texts and empty tables."""

from __future__ import annotations

import random
import re
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexarium.llm import base, encoding, language, leakage, neardup, packing, scans, site_lines, splitting, stuffing

PROSE = (
    "The section on pressure valves explains why the archive must be checked before winter. It was found that the readers and the drafts are kept in the same hall. "
    "When the limits are reached, two people have to inspect the frames, and they note what was changed."
)
DOC = "doc_id long, text string, lang string, source string, filetype string"


def docs(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


def text_rows(*texts):
    return [(k, t, "en", "a.example", "txt") for k, t in enumerate(texts)]


# p1


def site(spark):
    notice = "Share this page: mail, print"
    rows = [(k, f"Title {chr(97 + k)} text\n{notice if k % 2 else notice.upper()}\nLine of its own number {'abcdefghij'[k]}", "en", "a.example", "txt") for k in range(10)]
    rows += [(100 + k, f"Other words {'abcdefghijklmnop'[k]} here", "en", "b.example", "txt") for k in range(16)]
    return docs(spark, rows + [(200, None, None, "a.example", None), (201, notice, None, None, None), (202, "", None, "", None)])


def test_p1_finds_and_removes(spark):
    found = {(r.doc_id, r.line_no) for r in site_lines.repeated_lines(site(spark)).collect()}
    assert found == {(k, 1) for k in range(10)}
    clean = {r.doc_id: r for r in site_lines.remove_repeated_lines(site(spark).withColumn("clean_text", base.F.lit("old"))).collect()}
    assert clean[3].clean_text.count("\n") == 1 and "Share" not in clean[3].clean_text and clean[3].n_removed == 1
    assert clean[200].clean_text is None and clean[202].clean_text == "" and clean[201].n_removed == 0


def test_p1_shared_template_is_found_in_every_site(spark):
    rows = [(s * 100 + k, f"Same notice everywhere\nown text {s} {'abcdefghijklmnopqrst'[k]}", "en", f"s{s}.example", "txt") for s in range(5) for k in range(20)]
    assert site_lines.repeated_lines(docs(spark, rows)).count() == 100


def common_line(outside):
    """A notice in 12 of the 40 documents of a site and in `outside` of the 100 without a source."""
    rows = [(k, f"own text {chr(97 + k % 26) * (k // 26 + 1)}" + ("\nRead the notes first" if k < 12 else ""), None, "a.example", "txt") for k in range(40)]
    return rows + [(100 + k, f"more text {chr(97 + k % 26) * (k // 26 + 1)}" + ("\nRead the notes first" if k < outside else ""), None, None, "txt") for k in range(100)]


def test_p1_line_common_outside_is_no_line_of_the_site(spark):
    assert site_lines.repeated_lines(docs(spark, common_line(0))).count() == 12
    assert site_lines.repeated_lines(docs(spark, common_line(35))).count() == 0
    assert site_lines.repeated_lines(docs(spark, common_line(35)), fdr=2.0).count() == 12  # with the test switched off
    tested = {(r.docs, r.outside_docs, r.recurs) for r in site_lines.tested_lines(docs(spark, common_line(35))).collect()}
    assert (12, 35, True) in tested


def test_p1_one_site_alone(spark):
    rows = [(k, f"own {'abcdefghijklmnopqrst'[k]}\nThe same" if k < 6 else f"own {'abcdefghijklmnopqrst'[k]}", None, "a.example", "txt") for k in range(20)]
    assert site_lines.repeated_lines(docs(spark, rows)).count() == 6


def test_p1_many_sites_without_broadcast(spark, monkeypatch):
    few = {r.doc_id: (r.clean_text, r.n_removed) for r in site_lines.remove_repeated_lines(site(spark)).collect()}
    found = {(r.doc_id, r.line_no) for r in site_lines.repeated_lines(site(spark)).collect()}
    monkeypatch.setattr(site_lines, "BROADCAST_ROWS", 0)
    assert {r.doc_id: (r.clean_text, r.n_removed) for r in site_lines.remove_repeated_lines(site(spark)).collect()} == few
    assert {(r.doc_id, r.line_no) for r in site_lines.repeated_lines(site(spark)).collect()} == found


def test_p1_empty(spark):
    assert site_lines.repeated_lines(docs(spark, [])).count() == 0


# p2


def test_p2_labels():
    assert [language.label_language(x) for x in ("de_DE", "English", " FR ", "und", None, "", "x-klingon", "spa", "nl-BE")] == ["de", "en", "fr", None, None, None, None, "es", "nl"]


SENTENCES = {
    "en": ["The house stands where the river bends.", "They wrote that the night was long and cold.", "What should be done about the broken window?", "We have seen these things before winter."],
    "de": ["Das Haus steht dort, wo der Fluss sich biegt.", "Sie schrieben, dass die Nacht lang und kalt war.", "Was soll mit dem kaputten Fenster geschehen?", "Wir haben diese Dinge vor dem Winter gesehen."],
    "fr": ["La maison se trouve où la rivière tourne.", "Ils écrivaient que la nuit était longue et froide.", "Que faut-il faire de la fenêtre cassée?", "Nous avons vu ces choses avant les neiges."],
    "es": ["La casa está donde el río da la vuelta.", "Escribieron que la noche era larga y fría.", "¿Qué se debe hacer con la ventana rota?", "Hemos visto estas cosas antes del invierno."],
    "nl": ["Het huis staat waar de rivier een bocht maakt.", "Zij schreven dat de nacht lang en koud was.", "Wat moet er met het kapotte raam gebeuren?", "Wij hebben deze dingen voor de winter gezien."],
}


def paragraph(rng, lang, n=4):
    return " ".join(rng.choice(SENTENCES[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    samples = [("\n\n".join(paragraph(rng, lang) for _ in range(2)), lang if rng.random() > 0.05 else "en") for _ in range(60) for lang in SENTENCES]
    return language.train(samples)


def test_p2_held_out_accuracy(model):
    rng = random.Random(2)
    held = [(paragraph(rng, lang, 3), k) for _ in range(40) for k, lang in enumerate(language.LANGUAGES)]
    scores, _ = model.scores([t for t, _ in held])
    assert (scores.argmax(axis=1) == [k for _, k in held]).mean() >= 0.99
    p = model.probabilities(scores)
    assert abs(p.sum(axis=1) - 1).max() < 1e-6 and 0.2 <= model.temperature <= 20


def test_p2_assigns(spark, model):
    rng = random.Random(3)
    mixed = "\n\n".join([paragraph(rng, "de"), paragraph(rng, "en"), paragraph(rng, "de")])
    rows = [(1, mixed, "fr", None, None), (2, paragraph(rng, "nl"), "nl-BE", None, None), (3, None, "en", None, None), (4, " \n\n ", "en", None, None), (5, paragraph(rng, "es") + " " + "x9" * 60_000, None, None, None)]
    got = {(r.doc_id, r.seg_no): r for r in language.assign_languages(docs(spark, rows + rows[:1]), model).collect()}
    assert set(got) == {(1, -1), (1, 1), (2, -1), (5, -1)}
    assert got[1, -1].lang == "de" and got[1, -1].mislabelled and got[1, 1].lang == "en" and not got[2, -1].mislabelled and got[5, -1].lang == "es"
    cases = {(r.doc_id, r.seg_no) for r in language.assign_languages(docs(spark, rows), model, cases_only=True).collect()}
    assert cases == {(1, -1), (1, 1), (5, -1)}
    assert language.assign_languages(docs(spark, []), model).count() == 0


def test_p2_fit_without_texts_or_labels(spark):
    assert language.fit(docs(spark, text_rows(None, ""))).table.sum() == 0
    with pytest.raises(ValueError):
        language.fit(docs(spark, [(1, paragraph(random.Random(1), "en"), "und", None, None), (2, paragraph(random.Random(2), "de"), None, None, None)]))


@pytest.mark.parametrize("n", [1, 5_000, 10**8, 10**11, 10**14])
def test_p2_sample_share_at_any_size(n):
    """The expected number of documents under the bound is that of the sample, whatever their number."""
    share = (language.least_hash(1.2 * 3000 / n) + 2**63) / 2**64
    assert share * n == pytest.approx(min(n, 3600), rel=1e-3)


def test_p2_samples_the_least_hashes(spark):
    rng = random.Random(4)
    rows = [(k, paragraph(rng, lang, 2), lang, None, None) for k, lang in enumerate(list(SENTENCES) * 20)]
    assert (language.fit(docs(spark, rows), 60).table == language.fit(docs(spark, rows[::-1]).repartition(7), 60).table).all()


def test_p2_long_words_count_but_encoded_data_does_not():
    word = "Donaudampfschifffahrtselektrizitätenhauptbetriebswerk"
    grams, _ = language.trigrams([word])
    assert (grams != 0).sum() >= len(word) and (language.trigrams(["aGVsbG8gd29ybGQ0NTY3ODkwMTIzNDU2Nzg5MDEyMzQ1Njc4OTA="])[0] != 0).sum() == 0


# p3

SOUND = "Für größere Öfen gelten die übrigen Maße – siehe „Prüfung“ bei 20 °C."


@pytest.mark.parametrize("legacy", ["cp1252", "mac_roman", "cp437", "cp850", "latin-1"])
def test_p3_round_trip_utf8(legacy):
    garbled = SOUND.encode().decode(legacy if legacy != "cp1252" else "latin-1")
    assert garbled != SOUND and encoding.repair(garbled)[0] == SOUND


def test_p3_nested_and_partial():
    twice = "größer und schöner".encode().decode("cp1252").encode().decode("cp1252")
    text = f"Erste Zeile bleibt schön.\n{twice}\nDritte Zeile für alle."
    assert encoding.repair(text)[0] == "Erste Zeile bleibt schön.\ngrößer und schöner\nDritte Zeile für alle."


@pytest.mark.parametrize("legacy", ["mac_roman", "cp437", "cp1251"])
def test_p3_round_trip_single_byte(legacy):
    text = "Die früheren Öfen stören die größten Geräte während der Nacht."
    assert encoding.repair(text.encode("cp1252").decode(legacy))[0] == text


@pytest.mark.parametrize("text", ["Привет мир, это длинный текст о погоде", "Καλημέρα κόσμε, αυτό είναι το κείμενο"])
@pytest.mark.parametrize("page", ["cp1251", "koi8-r", "iso8859-5", "cp1253", "utf-8"])
def test_p3_other_scripts(text, page):
    """Restored, from a code page of their script or UTF-8 read as latin-1."""
    try:
        garbled = text.encode(page).decode("latin-1")
    except UnicodeError:
        return
    assert encoding.repair(garbled)[0] == text


@pytest.mark.parametrize("text", ["こんにちは世界、これは長い文章です", "你好世界这是一段文字"])
def test_p3_east_asian_utf8(text):
    assert encoding.repair(text.encode().decode("latin-1"))[0] == text


@pytest.mark.parametrize(("text", "page"), [("コンピュータの世界", "shift_jis"), ("Zażółć gęślą jaźń, proszę bardzo", "cp1250"), ("ПРИВЕТ ÀÁÂ", "utf-8")])
def test_p3_never_another_garbling(text, page):
    """What can't be restored is left as it is."""
    garbled = text.encode(page).decode("latin-1")
    assert encoding.repair(garbled)[0] in (garbled, text)


def test_p3_many_layers():
    garbled = "schöne Grüße"
    for _ in range(6):
        garbled = garbled.encode().decode("latin-1")
    assert encoding.repair(garbled)[0] == "schöne Grüße"


@given(st.text(alphabet="abc ABC.,äöüßéèêàçñáíóú’“”„–°\n", max_size=60))
@settings(max_examples=200, deadline=None)
def test_p3_sound_text_is_left_alone(text):
    if not re.search("[,.][íîöô]|[a-zà-ÿß][A-ZÀ-Þ]|(?<![a-zà-ÿA-Z])[öô][A-Z]|ôC", text):
        restored, how, _ = encoding.repair(text)
        assert restored == text or how


def test_p3_operator(spark):
    rows = [("documents", 1, "Ã¼ber den BrÃ¼cken"), ("documents", 2, None), ("documents", 3, ""), ("documents", 4, "über den Brücken"), ("documents", 5, "f�r alle"), ("text_blocks", 1, "ÂµM und 5 µm"), ("documents", 6, "12 ΜM" + " gut" * 50_000)]
    got = {(r.rec_table, r.rec_id): r for r in encoding.find_garbled(spark.createDataFrame([(*r, "x") for r in rows], "rec_table string, rec_id long, text string, encodings string")).collect()}
    assert set(got) == {("documents", 1), ("documents", 5), ("text_blocks", 1)}
    assert got["documents", 1].restored == "über den Brücken"
    assert encoding.find_garbled(spark.createDataFrame([], "rec_table string, rec_id long, text string")).count() == 0


# p4


def jaccard(a, b, size):
    x, y = ({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} for w in (base.words(a), base.words(b)))
    return len(x & y) / len(x | y)


def near_rows(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(n // 3):
        ws = [rng.choice(vocabulary) for _ in range(rng.randint(25, 120))]
        texts.append(" ".join(ws))
        for _ in range(2):
            other = ws[:]
            for _ in range(rng.randint(0, max(1, len(ws) // 18))):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts.append(" ".join(other).upper() + "!")
    return texts


@pytest.mark.parametrize(("size", "threshold"), [(3, 0.7), (5, 0.8)])
def test_p4_against_brute_force(spark, size, threshold):
    texts = near_rows(size)
    items = spark.createDataFrame([("documents", k, t) for k, t in enumerate(texts)] + [("sections", 0, texts[0]), ("documents", 0, texts[0]), ("documents", 900, None), ("documents", 901, "too short")], "rec_table string, rec_id long, text string")
    member, links = neardup.near_duplicates(items, threshold, size, 20)
    got = {(r.rec_table, r.id_a, r.id_b) for r in neardup.expand_pairs(member, links).collect()}
    assert got == {("documents", a, b) for a, b in combinations(range(len(texts)), 2) if jaccard(texts[a], texts[b], size) >= threshold}


def test_p4_copies_are_one_class(spark):
    text = " ".join(f"w{k}" for k in range(40))
    items = spark.createDataFrame([("documents", k, text) for k in range(50)] + [("documents", 99, text + " end")], "rec_table string, rec_id long, text string")
    member, links = neardup.near_duplicates(items, 0.7, 3, 20)
    assert {r.rep_id for r in member.collect()} == {0, 99}
    assert [(r.rep_a, r.rep_b) for r in links.collect()] == [(0, 99)]


def test_p4_empty_and_long(spark):
    member, links = neardup.near_duplicates(spark.createDataFrame([], "rec_table string, rec_id long, text string"))
    assert member.count() == 0 and links.count() == 0
    long = " ".join(f"w{k}" for k in range(150_000))
    member, links = neardup.near_duplicates(spark.createDataFrame([("documents", 1, long), ("documents", 2, long + " more")], "rec_table string, rec_id long, text string"))
    assert links.count() == 1


# p5


@given(st.text(alphabet="ab. ,\n\f;é", max_size=400), st.integers(1, 80), st.integers(0, 100))
@settings(max_examples=400, deadline=None)
def test_p5_pieces_reassemble(text, limit, overlap):
    out, kept = splitting.pieces(text, limit, overlap), min(overlap, limit - 1)
    assert all(len(p) <= limit for p in out)
    if len(out) > 1:
        assert out[0] + "".join(p[kept:] for p in out[1:]) == text
        assert all(b[:kept] == (out[0] + "".join(p[kept:] for p in out[1 : k + 1]))[-kept:] for k, b in enumerate(out[1:]) if kept)


def test_p5_prefers_strong_boundaries():
    paragraphs = ["One two three. Four five six.", "Seven eight nine. Ten eleven.", "Twelve, thirteen. Fourteen."]
    assert splitting.pieces("\n\n".join(paragraphs), 40, 0) == [paragraphs[0] + "\n\n", paragraphs[1] + "\n\n", paragraphs[2]]


def test_p5_operator(spark):
    limits = spark.createDataFrame([("documents", "txt", 100, 10), ("sections", "TABLE", 50, 0)], "rec_table string, kind string, max_chars int, overlap_chars int")
    documents = docs(spark, [(1, "word " * 100, None, None, "TXT"), (2, None, None, None, "txt"), (3, "short", None, None, "txt"), (4, "word " * 100, None, None, None), (5, "x" * 250_000, None, None, "txt"), (6, "", None, None, "txt")])
    sections = spark.createDataFrame([(1, "Table", "cell " * 30)] * 2 + [(2, None, "cell " * 30), (3, "table", None)], "section_id long, section_type string, content string")
    items = splitting.limited_records(documents, sections, limits)
    got = splitting.split_oversized(items, distinct_rows=True).collect()
    assert {(r.rec_table, r.rec_id) for r in got} == {("documents", 1), ("documents", 5), ("sections", 1)}
    assert sum(len(r.content) - r.overlap_chars for r in got if r.rec_id == 5) == 250_000
    assert len([r for r in got if r.rec_table == "sections"]) == len({r.piece_no for r in got if r.rec_table == "sections"})
    assert splitting.split_oversized(items.limit(0)).count() == 0


def test_p5_bad_limit():
    with pytest.raises(ValueError):
        splitting.pieces("abc", 0, 0)


# p6


def test_p6_parts_of_a_page():
    title = "Pump records: late Felurix"
    text = f"Page 3 of 9\nThe first line of the page goes on for some\nwhile and the next one does so too, as it\n{title.upper()}\nshould. The last pre-\nssure line was cut by the scanner's end\nand both pre- and post-shift stay as they are."
    heads, numbers = scans.page_parts(text, title, "www.felurix.example", False)
    assert not heads or text[slice(*heads[0])] == title.upper()
    assert [text[a:b] for a, b in numbers] == ["Page 3 of 9"]
    assert scans.cut_words(text, False) == [("pre", "ssure")]
    block = "the sensors Page 13 of 212 reject the FELURIX · NRV 3550-9 21 modules"
    heads, numbers = scans.page_parts(block, title, "www.felurix.example", True)
    assert [block[a:b] for a, b in heads] == ["FELURIX · NRV 3550-9"] and [block[a:b] for a, b in numbers] == ["Page 13 of 212", "21"]
    assert scans.page_parts("— 7 —", None, None, True)[1] and not scans.page_parts("All 7 of them.", None, None, True)[1]


def test_p6_operator(spark):
    clean = "the pressure modules follow the archive sensors carefully and return"
    blocks = [("text_blocks", k, clean, None, None, True) for k in range(60)]
    noisy = [("text_blocks", 100, "the prcssure rnodules follow the archive", None, None, True), ("text_blocks", 101, "the pres- sure modules and pre- and post-shift", None, None, True), ("text_blocks", 102, "the m0dules follow", None, None, True), ("text_blocks", 103, None, None, None, True), ("text_blocks", 104, "", None, None, True), ("text_blocks", 105, "[12]", "T", "x", True), ("documents", 1, clean, None, None, False)]
    items = spark.createDataFrame(blocks + noisy + noisy[:1], "rec_table string, rec_id long, text string, title string, source string, block boolean").withColumn("code", base.F.lit("NRV 1234-5"))
    got = {(r.rec_id, r.kind, r.fix) for r in scans.find_noise(items).collect()}
    assert {(100, "characters", "pressure"), (100, "characters", "modules"), (101, "hyphenation", "pressure"), (102, "characters", "modules"), (105, "page_number", None)} <= got
    assert {r for r, _, _ in got} == {100, 101, 102, 105}
    fixed = {r.rec_id: r.restored for r in scans.repair_scans(items, scans.find_noise(items)).collect()}
    assert fixed == {100: "the pressure modules follow the archive", 101: "the pressure modules and pre- and post-shift", 102: "the modules follow", 105: ""}
    assert scans.find_noise(items.limit(0)).count() == 0


def test_p6_context_picks_among_fixes(spark):
    """"barc" may be bare, the likelier confusion, or harc; the word before tells which."""
    rows = ["the walls stand bare now"] * 30 + ["they play harc music"] * 30 + ["they play barc music"]
    items = spark.createDataFrame([("text_blocks", k, t, None, None, None, True) for k, t in enumerate(rows)], "rec_table string, rec_id long, text string, title string, source string, code string, block boolean")
    assert {(r.rec_id, r.noisy, r.fix) for r in scans.find_noise(items).collect()} == {(60, "barc", "harc")}
    assert {(r.rec_id, r.noisy, r.fix) for r in scans.find_noise(items, context=False).collect()} == {(60, "barc", "bare")}


# p7


@given(st.lists(st.integers(1, 64), max_size=120), st.booleans())
@settings(max_examples=200, deadline=None)
def test_p7_bins(sizes, top_up):
    bins = packing.harmonic_bins(sizes, 64, top_up)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 64 for b in bins)


@given(st.text(alphabet="ab1.,' \n\t é’-sS", max_size=40))
@settings(max_examples=300, deadline=None)
def test_p7_counts_tokens_exactly(text):
    counter = packing.counter(packing.TOKENIZER)
    assert counter.count(text) == len(counter.encode(text))


def test_p7_operator(spark):
    pools = spark.createDataFrame([("txt", 64)], "filetype string, capacity_tokens int")
    rows = [(k, f"word number {k} " * (k % 9 + 1), None, None, "txt") for k in range(200)] + [(900, "many words here " * 3_000, None, None, "txt"), (901, None, None, None, "txt"), (902, "", None, None, "txt"), (903, "no pool", None, None, None)]
    got = packing.pack_documents(docs(spark, rows), pools).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    fill = {}
    for r in got:
        if r.container:
            fill[r.container] = fill.get(r.container, 0) + r.n_tokens
    assert max(fill.values()) <= 64 and sum(fill.values()) / (64 * len(fill)) > 0.9
    assert all(r.container is None for r in got if r.doc_id > 900) and len([r for r in got if r.doc_id == 900]) > 1
    assert packing.pack_documents(docs(spark, []), pools).count() == 0


# p8


def test_p8_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"t{k}" for k in range(12)]
    cases = [(k, " ".join(rng.choice(words) for _ in range(25)), None if k % 3 else " ".join(rng.choice(words) for _ in range(12)), "") for k in range(8)] + [(50, "too short", None, None)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) + " " + (cases[k % 8][1].upper().replace(" ", ", ") if k % 2 else "") for k in range(30)]
    runs = {(c, tuple(w[k : k + 5])) for c, *fields in cases for f in fields if f for w in [base.words(f)] for k in range(len(w) - 4)}
    want = {(c, d) for d, t in enumerate(texts) for w in [base.words(t)] for k in range(len(w) - 4) for c, r in runs if r == tuple(w[k : k + 5])}
    rows = text_rows(*texts) + [(900, None, None, None, None), (901, "", None, None, None)]
    frame = spark.createDataFrame(cases + cases[:1], "case_id long, query string, expected_answer string, passage string")
    assert {(r.case_id, r.doc_id) for r in leakage.find_leaks(docs(spark, rows), frame, 5).collect()} == want
    assert {(r.case_id, r.doc_id) for r in leakage.find_leaks(docs(spark, rows), frame, 5, block_chars=100).collect()} == want
    assert leakage.find_leaks(docs(spark, rows), frame.limit(0), 5).count() == 0 and leakage.find_leaks(docs(spark, []), frame, 5).count() == 0


# p9


@given(st.text(alphabet="abc", max_size=50), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_p9_cover_against_brute_force(text, least):
    want = [False] * len(text)
    for i in range(len(text)):
        for j in range(i + least, len(text) + 1):
            if text.find(text[i:j]) == text.rfind(text[i:j]):
                break
            for k in range(i, j):
                want[k] = True
    assert stuffing.repeated_cover(text, least) == want


def test_p9_operator(spark):
    rng = random.Random(4)
    keys = ["valve modules", "cheap sensors", "pump records", "order now"]
    spam = "; ".join(rng.choice(keys) for _ in range(80))
    links = "\n".join(f"https://shop{k}.example/a{k}/b" for k in range(60))
    honest = PROSE * 3 + "\n" + "\n".join(f"[{k}] https://docs.example/{k}" for k in range(5))
    rows = text_rows(spam, links, honest, None, "", "valve valve", spam * 200)
    got = {r.doc_id: r for r in stuffing.score_pages(docs(spark, rows)).collect()}
    assert {k for k, r in got.items() if r.stuffed} == {0, 1, 6} and len(got) == 7 and got[3].n_words == 0
    assert {r.doc_id for r in stuffing.stuffed_pages(docs(spark, rows)).collect()} == {0, 1, 6}
    assert stuffing.stuffed_pages(docs(spark, [])).count() == 0

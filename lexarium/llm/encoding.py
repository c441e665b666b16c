"""Garbled text from wrong character encoding (problem 3).

Round-trip repair: a garbled stretch is encoded again under candidate legacy encodings and strictly decoded as the
intended one, repeatedly for nested layers; a step is accepted when a garbling cost drops. The cost counts characters
and contexts that text in western European languages doesn't have. Whole lines are tried first, then single tokens,
so that a garbled part of an otherwise sound text is repaired as well.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_arrow

_LOWER = "a-zß-öø-ÿœ"
_UPPER = "A-ZÀ-ÖØ-ÞŒ"
_LETTER = _LOWER + _UPPER
#: Second characters of a two- or three-byte UTF-8 sequence read as cp1252 or latin-1.
_TAIL = "\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™"

_SIGNS = "¸˙˝˛ˇ˘˚ˆ‡†‚ƒ„‰¢£¤¥¦¨ª¶¯±²³´¹º¼½¾×÷¡¿·‹›ﬂ"
_CAPITALS = "ÀÁÂÃÈÉÊËÌÍÎÏÒÓÔÕÙÚÛÇÑÆÅØÞÐÝ"
_FOREIGN = "ΐ-ΛΝ-Ψα-λν-ωЀ-џ"
_BOX = "─-▟⌐¬"

#: What garbles: each match costs one. Java and Python read this pattern alike. It begins with one class of characters,
#: so that sound text is passed over fast; each context looks back at that character.
SUSPECT = f"[\u0080-\u009f\ue000-\uf8ff�â{_CAPITALS}Ä√{_BOX}ⁿ≤≥⌠⌡≈∙∞{_FOREIGN}{_SIGNS}ìòþðýõíîöôëûñù](?:" + "|".join(
    (
        "(?<=[\u0080-\u009f\ue000-\uf8ff�])",  # control characters, private use, lost characters
        f"(?<=[ÃÂÅÄ])[{_TAIL}]|(?<=â)[€\u0080-\u0084]|(?<=Ã)(?![{_LETTER}])",  # UTF-8 read as a Latin code page
        f"(?<=[ÎÏÐÑ])[{_TAIL}][ÎÏÐÑ]|(?<=[ã-é])[{_TAIL}]{{2}}[ã-é][{_TAIL}]{{2}}",  # that of Greek, Cyrillic or East Asian letters
        "(?<=[ÔÃ])Ç|(?<=[┬├√]).|(?<=¬)[®©´ª±∞•†π¢£§∂ø¿¡]|(?<=‚)Ä",  # UTF-8 read as a DOS code page or as that of the Macintosh
        f"(?<=[{_BOX}])(?=[A-Za-z])|(?<=[A-Za-z][─-▟⌐ⁿ≤≥⌠⌡≈∙])|(?<=[░∞╡█▀])",
        f"(?<=[{_LETTER}][{_FOREIGN}])|(?<=[{_FOREIGN}])(?=[{_LETTER}])",  # mixed scripts
        f"(?<=[{_LETTER}][{_CAPITALS}])(?=[{_LOWER}])|(?<=[a-z][{_CAPITALS}])",  # capitals inside a word
        f"(?<=[a-zA-Z][{_SIGNS}])(?=[a-zA-Z])|(?<![{_LETTER}][¸˙˚ˆ‡‰‹÷])(?<=[¸˙˚ˆ‡‰‹÷])(?=[a-z])",  # signs inside a word
        f"(?<=[ìòþðýõÕ])|(?<=[,.!?][íîöôëû])(?![{_LETTER}])|(?<![{_LETTER}][ôö])(?<=[ôö])(?=[A-Z][a-z])|(?<= [ñíûùÐÑ])(?= )|(?<=[Ii]t[íÆ])s(?![{_LETTER}])",  # quotes and dashes that became letters
    )
) + ")"
_SUSPECT = re.compile(SUSPECT)
#: Signs that a stretch holds UTF-8 read as something else, so that it can't be one single-byte encoding read as another.
_UTF8 = re.compile(f"[ÃÂ][{_TAIL}]|â[€\u0080-\u0084]|[ÔÃ]Ç|[┬├√][^ ]|¬[®©´ª±∞]|‚Ä")

_CP1252 = {ord(bytes([b]).decode("cp1252")): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
#: Legacy encodings under which text is encoded again; "western" is cp1252 with its holes filled from latin-1, so it covers both.
LEGACY = ("western", "mac_roman", "cp437", "cp850", "cp1251", "cp1250")
INTENDED = ("utf-8", "cp1252")

#: Three and more letters with marks or signs in a row: no language written in Latin letters has them, so a repair that leaves them isn't one.
_WRECK = re.compile("[À-ÖØ-öø-ÿŠšŽžŒœŸƒ†‡•ˆ‰¤¦¨¬¯´¶¸¹º¼½¾×÷]{3,}")
_EAST = "\u1100-\u11ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af"
#: A single East Asian character within something else, as three bytes that happen to be UTF-8 give it.
_LONE = re.compile(f"(?<![{_EAST}])[{_EAST}](?![{_EAST}])")
#: Words of letters with marks only, as a Cyrillic or Greek code page read as a western one gives them.
_MARKED = re.compile(r"[¡-ÿ]+(?:[ ,.;:!?()\"–-]+[¡-ÿ]+)*")
LEAST_MARKED = 8
#: Code pages of other scripts, the range of their letters, and the commonest letters of their languages.
SCRIPTS = (
    ("cp1251", "а-яёА-ЯЁ", "оеаинтсрвлкм"),
    ("koi8-r", "а-яёА-ЯЁ", "оеаинтсрвлкм"),
    ("iso8859-5", "а-яёА-ЯЁ", "оеаинтсрвлкм"),
    ("cp1253", "α-ωάέήίόύώϊϋΑ-ΩΆΈΉΊΌΎΏ", "αοιετσνηυρπκ"),
)


def garbling_cost(text: str) -> int:
    """How many characters or contexts of the text look garbled."""
    return len(_SUSPECT.findall(text))


def _encode(text: str, legacy: str) -> bytes:
    return text.translate(_CP1252).encode("latin-1") if legacy == "western" else text.encode(legacy)


def _step(text: str, intended: str) -> tuple[str, str] | None:
    """The best accepted round trip of a stretch: the text and the encodings.

    A strict decode as UTF-8 is evidence by itself, so any drop of the cost, or else of the number of characters beyond
    ASCII, will do; for a single-byte encoding three quarters of the cost must go.
    """
    cost = garbling_cost(text)
    limit = (cost, _beyond(text)) if intended == "utf-8" else (cost // 4, len(text))
    best = None
    for legacy in LEGACY:
        if legacy == "western" and intended == "cp1252":
            continue
        try:
            back = _encode(text, legacy).decode(intended)
        except UnicodeError:
            continue
        new = (garbling_cost(back), _beyond(back))
        if intended == "cp1252" and _WRECK.search(back) or intended == "utf-8" and _LONE.search(back) and not _LONE.search(text):
            continue  # another garbling
        if back != text and (new < limit if intended == "utf-8" else new[0] <= limit[0] and new[0] < cost) and (best is None or new < best[0]):
            best = (new, back, f"{intended}>{legacy}")
    return best and best[1:]


def _other_script(text: str) -> tuple[str, list[str]]:
    """A line with its stretches of marked letters read under the code page of another script, where that gives words of it.

    Such words have letters of the script alone, no capitals after small letters, and mostly its commonest letters.
    """
    done: list[str] = []

    def read(m: re.Match) -> str:
        marked = m.group()
        if sum(map(str.isalpha, marked)) < LEAST_MARKED or not re.search("[À-ÿ¨¸]{4}", marked):
            return marked
        best = (0.5, marked, "")
        for page, letters, common in SCRIPTS:
            try:
                back = _encode(marked, "western").decode(page)
            except UnicodeError:
                continue
            own = re.findall(f"[{letters}]", back)
            if len(own) < sum(map(str.isalpha, back)) or re.search("(?<=[а-яёά-ώ])[А-ЯЁΑ-Ω]", back):
                continue
            best = max(best, (sum(c.lower() in common for c in own) / len(own), back, f"{page}>western"))
        if best[2]:
            done.append(best[2])
        return best[1]

    return _MARKED.sub(read, text), done


def _beyond(text: str) -> int:
    return len(text) - len(text.encode("ascii", "ignore"))


def _layers(text: str, intended: str) -> tuple[str, list[str]]:
    """Repair a stretch layer by layer."""
    steps: list[str] = []
    while _SUSPECT.search(text) and (better := _step(text, intended)):  # each step lowers the cost or the number of characters beyond ASCII
        text = better[0]
        steps.append(better[1])
    return text, steps


_TOKENS = re.compile(r"([ \t]+)")


def _repair_line(line: str) -> tuple[str, list[str]]:
    line, done = _other_script(line)
    for intended in INTENDED:
        if not _SUSPECT.search(line) or intended == "cp1252" and _UTF8.search(line):
            break
        line, steps = _layers(line, intended)
        done += steps
        if _SUSPECT.search(line):
            parts = _TOKENS.split(line)
            for j, part in enumerate(parts):
                if part and _SUSPECT.search(part):
                    parts[j], steps = _layers(part, intended)
                    done += steps
            line = "".join(parts)
    return line, done


def repair(text: str) -> tuple[str, list[str], int]:
    """The text with its garbled stretches restored, the encodings undone, and the cost that remains."""
    if not _SUSPECT.search(text):
        return text, [], 0
    done: list[str] = []
    lines = text.split("\n")
    for k, line in enumerate(lines):
        if _SUSPECT.search(line):
            lines[k], steps = _repair_line(line)
            done += steps
    text = "\n".join(lines)
    return text, sorted(set(done)), garbling_cost(text)


REPAIRED = "rec_table string, rec_id bigint, restored string, encodings array<string>, cost_before int, cost_after int"


def find_garbled(items: DataFrame) -> DataFrame:
    """The garbled records of items (rec_table, rec_id, text) with what could be restored of their text.

    A record is garbled if a round trip was accepted in it, or if characters of it are lost (U+FFFD) or are control
    characters of a misread byte. encodings names the accepted round trips; cost_after counts what is left garbled. Null and
    empty texts and sound ones give no rows; repeated rows give repeated rows. Rows without any suspicious character
    are ruled out by the same pattern before they travel to Python. encodings is empty where characters are lost.
    """

    def work(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("rec_table", "rec_id", "restored", "encodings", "cost_before", "cost_after")}
        for rec_table, rec_id, text in zip(cols["rec_table"], cols["rec_id"], cols["text"]):
            restored, how, left = repair(text)
            if how or _LOST.search(text):
                for k, v in zip(out, (rec_table, rec_id, restored, how, garbling_cost(text), left)):
                    out[k].append(v)
        return out

    return map_arrow(items.select("rec_table", "rec_id", "text").filter((F.octet_length("text") > F.length("text")) & F.col("text").rlike(SUSPECT)), REPAIRED, work)


_LOST = re.compile("[�\u0080-\u0084\u0086-\u009f]")

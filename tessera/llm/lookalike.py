"""Character tables for text that looks the same (used by problems 1, 2, 7 and 8).

All large tables are built by rule from the Unicode character database, all planes; only the
letters of other alphabets that look like Latin ones are stated.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

#: Letters of other alphabets and the Latin letters that look the same (Cyrillic, Greek, Armenian, Cherokee, Coptic, Latin).
LETTERS = (
    ("АВЕЅІЈКМНОРСТХУԚԜҮЁЇӀ", "ABESIJKMHOPCTXYQWYËÏI"),
    ("аеѕіјорсхуһԁԛԝёїӏ", "aesijopcxyhdqwëïl"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ABEZHIKMNOPTYXC"),
    ("αγικνορυϲϳ", "ayikvopucj"),
    ("օՕՍսոհցԼ", "oOUunhgL"),
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),
    ("ⲟⲢⲤⲞ", "oPCO"),
    ("ıɡɑ", "iga"),
)
#: Hyphen and dash forms that look like the ASCII hyphen.
HYPHENS = "‐‑‒–−﹣－⁃"
#: Code points that hold characters with a compatibility form; the planes between hold ideographs and private characters.
RANGES = ((0x80, 0xD800), (0xE000, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))


def characters() -> Iterator[str]:
    for low, high in RANGES:
        yield from map(chr, range(low, high))


@functools.cache
def removed() -> str:
    """Invisible characters: format controls, tags, variation selectors and fillers."""
    listed = [chr(c) for c in (*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), 0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164)]
    return "".join(dict.fromkeys([ch for ch in characters() if unicodedata.category(ch) == "Cf"] + listed))


@functools.cache
def single_map() -> dict[str, str]:
    """Characters that look like one other character. Line breaks stay what they are."""
    out: dict[str, str] = {"\t": " "}
    for ch in characters():
        if ch in "\x85\u2028\u2029":
            continue
        if unicodedata.category(ch) == "Zs":
            out[ch] = " "
        elif _same_looking(ch):
            out[ch] = unicodedata.normalize("NFKC", ch)
    for source, target in LETTERS:
        out |= dict(zip(source, target, strict=True))
    # a letter of another alphabet in a styled or wide form looks like the Latin letter too
    out = {a: out.get(b, b) for a, b in out.items()} | dict.fromkeys(HYPHENS, "-")
    for ch in removed():
        out.pop(ch, None)
    return out


def _same_looking(ch: str) -> bool:
    """Width forms, styled mathematical letters, compatibility ideographs and radicals; not superscripts or circled forms."""
    folded = unicodedata.normalize("NFKC", ch)
    if len(folded) != 1 or folded == ch:
        return False
    kind = unicodedata.decomposition(ch).split(" ")[0]
    return kind in ("<wide>", "<narrow>", "<noBreak>", "<font>") or 0x2E80 <= ord(ch) < 0x2FE0 or kind and not kind.startswith("<")


@functools.cache
def expansions() -> dict[str, str]:
    """Single characters that look like several, as ligatures."""
    return {ch: folded for c in (*range(0xFB00, 0xFB07), 0x0132, 0x0133, 0x01C7, 0x01C9, 0x01CA, 0x01CC, 0x2026) if (folded := unicodedata.normalize("NFKC", ch := chr(c))) != ch and len(folded) > 1 and c != 0x2026}


@functools.cache
def _table() -> dict[int, str]:
    out: dict[int, str | None] = {ord(a): b for a, b in (single_map() | expansions()).items()}
    return out | dict.fromkeys(map(ord, removed()), "")


def skeleton(text: str) -> str:
    """One form for texts that look the same, composed; case and accents stay."""
    if text.isascii():
        return text.replace("\t", " ")
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(_table()))


@functools.cache
def positional_table() -> dict[int, str]:
    """Look-alikes that keep every position: one character for one (invisible ones become U+2060)."""
    out = {ord(a): b for a, b in single_map().items() if len(b) == 1}
    return out | dict.fromkeys(map(ord, removed()), "⁠")


INVISIBLE = re.compile("⁠")
assert sys.maxunicode > 0xFFFF

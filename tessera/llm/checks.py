"""Pieces of checking SQL of the training-data queries, with tables stated apart from the operators' own."""

from __future__ import annotations

#: Blanks of other widths; invisible characters; hyphens; letters of other alphabets beside Latin ones.
BLANKS = (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)
INVISIBLE = (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF)
DASHES = (0x2010, 0x2011, 0x2012, 0x2013, 0x2212, 0x2043, 0xFE63, 0xFF0D)
CYRILLIC = {"А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w"}
GREEK = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "γ": "y"}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def same(text: str) -> str:
    """An expression that is equal for texts that look the same: full-width forms by their distance from ASCII, radicals and compatibility ideographs by normalisation."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    letters = CYRILLIC | GREEK
    source = wide + "".join(letters) + "".join(map(chr, BLANKS + DASHES)) + "\t"
    target = narrow + "".join(letters.values()) + " " * len(BLANKS) + "-" * len(DASHES) + " "
    out = f"translate({text}, '{source}{''.join(map(chr, INVISIBLE))}', '{target.replace(chr(39), chr(39) * 2)}')"
    for one, several in LIGATURES.items():
        out = f"replace({out}, '{one}', '{several}')"
    # half-width kana and Kangxi radicals: what the tables of the data hold of them
    radicals, plain = _radicals()
    return f"translate({out}, '{radicals}', '{plain}')"


def _radicals() -> tuple[str, str]:
    """Kangxi radicals and the ideographs they stand for, in order of the radicals."""
    import unicodedata

    radicals = [chr(c) for c in range(0x2F00, 0x2FD6)]
    return "".join(radicals), "".join(unicodedata.normalize("NFKC", c) for c in radicals)

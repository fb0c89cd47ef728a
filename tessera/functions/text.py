"""Scalar text expressions (JVM side, no Python workers)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the token estimate: an ideograph, a Latin word and any other sign.
CJK_WEIGHT, WORD_WEIGHT, OTHER_WEIGHT = 1.0, 1.3, 0.35
CJK = "㐀-䶿一-鿿"
WORD = "[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)*"
#: White space as Python's \s has it; Java's \s is ASCII only.
SPACE = "\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def estimate_tokens(text: Column) -> Column:
    """max(1, ceil(ideographs + 1.3 words + 0.35 other signs)); null for null."""
    # single signs are counted as what is left when runs of all others are taken out: a few long matches, not one per sign
    cjk = F.length(F.regexp_replace(text, f"[^{CJK}]+", "")).cast("double")
    words = F.regexp_count(text, F.lit(WORD)).cast("double")
    other = F.length(F.regexp_replace(text, f"[{SPACE}A-Za-z0-9{CJK}]+", "")).cast("double")
    raw = F.ceil(cjk + words * F.lit(WORD_WEIGHT) + other * F.lit(OTHER_WEIGHT)).cast("int")
    return F.when(text.isNotNull(), F.greatest(F.lit(1), raw))


def exceeds_tokens(text: Column, limit: int) -> Column:
    """estimate_tokens(text) > limit; a text short enough to be within it whatever it holds is not scanned."""
    return F.when(F.length(text) * F.lit(WORD_WEIGHT) <= F.lit(float(limit)), F.lit(False)).otherwise(estimate_tokens(text) > limit)


#: Line ends beside \n, and what counts as a bare bullet.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
BULLETS = "\\uf0b7\\u2022\\u25cf\\u25aa"
#: The structural lines of a regulation.
CHAPTER = "(?i)^(第[一二三四五六七八九十百0-9]+[" + SPACE + "]*章\\b.*|chapter[" + SPACE + "]+[0-9]+\\b.*)$"
SECTION = "^((?:[0-9]+(?:\\.[0-9]+){1,5})|(?:[0-9]+\\.))[" + SPACE + "]*(.*)$"
LIST_ITEM = "(?i)^(?:[•●▪◦]|\\([a-zivx0-9]+\\)|[a-zivx0-9]+[.)])[" + SPACE + "]*"
PAGE_NUMBER = "(?i)^(?:page[" + SPACE + "]+)?[0-9]+$"


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility composition; ASCII texts never leave the JVM."""
    return F.when(is_ascii(text), text).otherwise(_nfkc(F.when(~is_ascii(text), text)))


def folded(text: Column) -> Column:
    """Compatibility composition and full case folding; ASCII texts never leave the JVM."""
    return F.when(is_ascii(text), F.lower(text)).otherwise(_folded(F.when(~is_ascii(text), text)))


def casefold(text: Column) -> Column:
    """Lower case with sharp s as ss. (lower(upper(x)) would be simplified to lower(x).)"""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def squeeze(text: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def normalize_term(text: Column) -> Column:
    """The form under which terms are counted: folded, only letters a-z, digits, ideographs, apostrophe and hyphen."""
    kept = F.regexp_replace(folded(F.coalesce(text, F.lit(""))), f"[^a-z0-9{CJK}'\\- ]+", " ")
    plain = F.regexp_replace(F.regexp_replace(kept, " +", " "), "^[-' ]+|[-' ]+$", "")
    return F.when(plain.rlike(f"[{CJK}]") & ~plain.rlike("[a-z0-9]"), F.replace(plain, F.lit(" "), F.lit(""))).otherwise(plain)


def detect_language(text: Column) -> Column:
    """zh, mixed or en; en also where there is neither script."""
    text = F.coalesce(text, F.lit(""))
    cjk, latin = text.rlike(f"[{CJK}]"), text.rlike("[A-Za-z]")
    return F.when(cjk & latin, "mixed").when(cjk, "zh").otherwise("en")


def normalize_question(text: Column) -> Column:
    """Folded, punctuation to blanks, one blank between words, two spellings unified."""
    plain = F.regexp_replace(folded(F.coalesce(text, F.lit(""))), "\\p{P}", " ")
    return F.replace(F.replace(squeeze(plain), F.lit("身份"), F.lit("身分")), F.lit("帳戶"), F.lit("戶口"))


def stable_hash(length: int, *values: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *values), 256), 1, length)


def match_type(normalized: Column, language: Column) -> Column:
    return F.when((language == "en") & ~normalized.contains(" "), "word").otherwise("phrase")


def quoted(text: Column) -> Column:
    """A text as a literal pattern."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def count_occurrences(text: Column, term: Column, kind: Column) -> Column:
    """How often a term occurs in a text, both folded: whole words for kind word, else parts that do not overlap; 0 for nothing."""
    word = F.regexp_count(text, F.concat(F.lit("(?<![a-z0-9_])"), quoted(term), F.lit("(?![a-z0-9_])")))
    part = F.regexp_count(text, quoted(term))
    sound = text.isNotNull() & term.isNotNull() & (F.length(term) > 0)
    return F.when(~sound, 0).when(kind == "word", word).otherwise(part)


def evidence_weight(score: Column, normalized: Column, chunk_frequency: Column, chunks: Column | int) -> Column:
    """score * phrase factor * inverse chunk frequency, rounded to 8 places."""
    n = chunks if isinstance(chunks, Column) else F.lit(chunks)
    size = F.when(normalized.rlike(f"[{CJK}]"), F.length(F.replace(normalized, F.lit(" "), F.lit(""))) / F.lit(4.0)).otherwise(
        F.size(F.filter(F.split(normalized, " "), lambda w: w != "")) / F.lit(2.0)
    )
    rarity = F.log((n + 1).cast("double") / (F.greatest(chunk_frequency, F.lit(1)) + 1)) / F.log((n + 1).cast("double"))
    return F.round(score * F.least(F.lit(1.0), size) * rarity, 8)

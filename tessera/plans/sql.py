"""Pieces of the checking SQL that several queries share."""

from __future__ import annotations

import functools
import unicodedata

CHUNKS = "c AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC NULLS LAST) = 1)"
TERMS = "t AS (SELECT * FROM terms WHERE term_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY updated_at DESC NULLS LAST) = 1)"
DOCUMENTS = "d AS (SELECT * FROM source_documents WHERE document_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC NULLS LAST) = 1)"
PAGES = "p AS (SELECT coalesce(source, 'none') AS doc, (row_number() OVER (PARTITION BY coalesce(source, 'none') ORDER BY doc_id))::INT AS page, doc_id, coalesce(text, '') AS text FROM documents)"
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CJK = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
#: Clean lines of the pages: (doc, page, n, line).
LINES = (
    PAGES
    + rf""", raw AS (SELECT doc, page, unnest(regexp_split_to_array(translate(text, chr(0) || chr(160), '  '), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')) AS s, generate_subscripts(regexp_split_to_array(translate(text, chr(0) || chr(160), '  '), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), 1) AS i FROM p),
    clean AS (SELECT doc, page, i, regexp_replace(regexp_replace(s, '[ \t]+', ' ', 'g'), '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS line FROM raw),
    l AS (SELECT doc, page, (row_number() OVER (PARTITION BY doc, page ORDER BY i))::INT AS n, CASE WHEN line IN (chr(61623), chr(8226), chr(9679), chr(9642)) THEN '•' ELSE line END AS line FROM clean WHERE line <> '')"""
)
KEY = rf"replace(lower(trim(regexp_replace(line, '[{SPACE}]+', ' ', 'g'))), 'ß', 'ss')"
#: The structural lines of a regulation.
SECTION = rf"^((?:[0-9]+(?:\.[0-9]+){{1,5}})|(?:[0-9]+\.))[{SPACE}]*(.*)$"
CHAPTER = rf"(?i)^(第[一二三四五六七八九十百0-9]+[{SPACE}]*章\b.*|chapter[{SPACE}]+[0-9]+\b.*)$"
LIST_ITEM = rf"(?i)^(?:[•●▪◦]|\([a-zivx0-9]+\)|[a-zivx0-9]+[.)])[{SPACE}]*"


def tokens(text: str) -> str:
    """The token estimate of a SQL expression."""
    return rf"""greatest(1, ceil(len(regexp_extract_all({text}, '[{CJK}]')) + 1.3::DOUBLE * len(regexp_extract_all({text}, '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*'))
        + 0.35::DOUBLE * len(regexp_extract_all({text}, '[^{SPACE}A-Za-z0-9{CJK}]'))))::INT"""


@functools.cache
def _compatible() -> tuple[tuple[str, str], tuple[tuple[str, str], ...]]:
    single, several = {}, []
    for c in range(0x80, 0x10000):
        ch = chr(c)
        if 0xD800 <= c < 0xE000 or (k := unicodedata.normalize("NFKC", ch)) == ch:
            continue
        if len(k) == 1:
            single[ch] = k
        elif 0xFB00 <= c < 0xFB07 or c == 0x2026:
            several.append((ch, k))
    return ("".join(single), "".join(single.values())), tuple(several)


def folded(text: str) -> str:
    """Compatibility composition and lower case of a SQL expression, from the Unicode tables (single signs, ligatures, ellipsis)."""
    (a, b), several = _compatible()
    out = f"translate({text}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    for x, y in several:
        out = f"replace({out}, '{x}', '{y}')"
    return f"replace(replace(lower(nfc_normalize({out})), 'ß', 'ss'), 'ς', 'σ')"


def unit_dot(a: str, b: str) -> str:
    """Cosine of two arrays in double precision."""
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


#: The concept edge of every chunk with a usable vector: the most similar leaf concept.
ABOUT = (
    CHUNKS
    + f""", sims AS (SELECT chunk_id, concept_id, round({unit_dot('c.embedding', 'k.embedding')}, 6) AS s, {unit_dot('c.embedding', 'k.embedding')} AS raw
        FROM c JOIN (SELECT DISTINCT concept_id, embedding FROM concepts WHERE level = 2 AND embedding IS NOT NULL) k ON len(c.embedding) = len(k.embedding) WHERE list_max(list_transform(c.embedding, lambda x: abs(x))) > 0),
    about AS (SELECT chunk_id, concept_id, s AS semantic_similarity, round(greatest(0, least(1, raw * 0.8)), 6) AS confidence FROM sims QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY s DESC, concept_id) = 1)"""
)


def mentioned() -> str:
    """CTEs c, t and cm (chunk_id, concept_id, confidence): concepts that chunks mention by their terms."""
    word = lambda x: f"CASE WHEN match_type = 'word' THEN len(regexp_extract_all({x}, '\\b' || regexp_escape(x) || '\\b')) ELSE (length({x}) - length(replace({x}, x, ''))) // length(x) END"
    return f"""{CHUNKS}, {TERMS}, fc0 AS (SELECT chunk_id, {folded('coalesce(retrieval_text, text)')} AS r FROM c), ft0 AS (SELECT term_id, concept_id, match_type, evidence_weight, {folded('text')} AS x FROM t WHERE text <> ''),
        pr0 AS (SELECT chunk_id, concept_id, coalesce(evidence_weight, 0) AS w, {word('r')} AS n FROM fc0 JOIN ft0 ON contains(r, x)), tp0 AS (SELECT concept_id, max(coalesce(evidence_weight, 0)) AS top FROM t GROUP BY concept_id),
        ag0 AS (SELECT chunk_id, concept_id, max(w) AS w FROM pr0 WHERE n > 0 GROUP BY ALL), cm AS (SELECT chunk_id, concept_id, round(CASE WHEN top > 0 THEN w / top ELSE 0 END, 6) AS confidence FROM ag0 JOIN tp0 USING (concept_id) WHERE CASE WHEN top > 0 THEN w / top ELSE 0 END >= 0.45)"""


MENTIONED = mentioned()

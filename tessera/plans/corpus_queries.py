"""Queries on page texts, structure and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import structure as S
from tessera.plans import sql
from tessera.plans.runtime import read_table, spread
from tessera.sources import files, tables


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


def chunk_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Estimate of each chunk beside the stored one, null where there is no text."""
    return tables.chunks(spark, d, "retrieval_text", "estimated_tokens").select("chunk_id", X.estimate_tokens(F.col("retrieval_text")).alias("tokens"), (X.estimate_tokens(F.col("retrieval_text")) == F.col("estimated_tokens")).alias("as_stored"))


def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    return S.lines_of(tables.pages_of_corpus(spark, d)).select("doc", "page", "n", "line")


def repeated_margins(spark: SparkSession, d: str) -> DataFrame:
    pages = tables.pages_of_corpus(spark, d)
    return S.repeated_margins(S.lines_of(pages), pages)


def margin_removed_lines(spark: SparkSession, d: str) -> DataFrame:
    pages = tables.pages_of_corpus(spark, d)
    return S.without_margins(S.lines_of(pages), pages)


def contents_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = tables.pages_of_corpus(spark, d)
    return S.contents_pages(S.lines_of(pages), pages)


def structural_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = S.classified(S.lines_of(tables.pages_of_corpus(spark, d)))
    return rows.where("structural").select("doc", "page", "n", "chapter", "section", "sid", "title", "level")


def line_joins(spark: SparkSession, d: str) -> DataFrame:
    """Whether a blank joins each line to the one before on its page."""
    rows = S.lines_of(tables.pages_of_corpus(spark, d))
    before = F.lag("line").over(Window.partitionBy("doc", "page").orderBy("n"))
    return rows.withColumn("before", before).where("before IS NOT NULL").select("doc", "page", "n", S.needs_space(F.col("before"), F.col("line")).alias("blank"))


def section_units(spark: SparkSession, d: str) -> DataFrame:
    pages = tables.pages_of_corpus(spark, d)
    return S.units_of(S.without_margins(S.lines_of(pages), pages))


def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The whole way from page texts to chunk rows."""
    return S.chunks_of(tables.pages_of_corpus(spark, d))


def budget_split(spark: SparkSession, d: str) -> DataFrame:
    parts = S.split_parts(spread(read_table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")), "text")
    return parts.select("doc_id", "part", F.length("text").alias("length"), X.estimate_tokens(F.col("text")).alias("tokens"))


def chunk_statistics(spark: SparkSession, d: str) -> DataFrame:
    return S.chunk_statistics(tables.chunks(spark, d, "text", "retrieval_text", "is_table_of_contents", "section_id"))


def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Name, length and hash of the table files themselves."""
    return files.source_files(spark, d, "parquet").select("file_name", "length", "sha256")


def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    """File names of the markdown export."""
    rows = tables.chunks(spark, d, "page", "chunk_index", "section_id", "split_part")
    return rows.select("chunk_id", files.chunk_file_name(rows).alias("file_name"))


def chunk_markdown(spark: SparkSession, d: str) -> DataFrame:
    return files.markdown(tables.chunks(spark, d, "source_file", "text", "retrieval_text", "document_sha256", "page", "chunk_index", "section_id", "section_title", "section_path", "is_table_of_contents", "estimated_tokens", "start_line", "end_line", "split_part", "chunking_method"))


def sample_chunk(spark: SparkSession, d: str) -> DataFrame:
    """The first chunk outside contents pages, with its citation."""
    rows = tables.chunks(spark, d, "source_file", "page", "chunk_index", "text", "section_path", "is_table_of_contents").where("text IS NOT NULL AND NOT coalesce(is_table_of_contents, false)")
    return rows.orderBy("source_file", "page", "chunk_index", "chunk_id").limit(1).select("chunk_id", "text", "section_path", F.format_string("[%s p.%d]", "source_file", "page").alias("citation"))


def export_index(spark: SparkSession, d: str) -> DataFrame:
    return files.document_index(tables.chunks(spark, d, "source_file", "is_table_of_contents"))


_C = sql
QUERIES = {f.__name__: f for f in (token_estimate, chunk_tokens, clean_lines, repeated_margins, margin_removed_lines, contents_pages, structural_lines, line_joins, section_units, section_chunks, budget_split, chunk_statistics, file_hashes, chunk_files, chunk_markdown, sample_chunk, export_index)}
_REPEATED = f"""z AS (SELECT *, n <= 6 OR n > max(n) OVER (PARTITION BY doc, page) - 6 AS margin, {_C.KEY} AS key FROM l),
    rep AS (SELECT z.doc, key, count(DISTINCT page) AS pages FROM z JOIN (SELECT doc, count(DISTINCT page) AS k FROM p GROUP BY doc HAVING count(DISTINCT page) >= 3) q USING (doc)
        WHERE margin AND length(line) <= 140 AND key <> '' GROUP BY z.doc, key, k HAVING count(DISTINCT page) >= greatest(3, ceil(k * 0.25)))"""


def _safe(x: str) -> str:
    return rf"""coalesce(nullif(trim(regexp_replace(regexp_replace({x}, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '[{_C.SPACE}]+', ' ', 'g'), ' .'), ''), 'untitled')"""


_FILE = f"printf('p%04d_c%03d_', page, chunk_index) || {_safe("coalesce(section_id, 'no-section')")} || CASE WHEN split_part > 1 THEN printf('_part-%02d', split_part::INT) ELSE '' END || '.md'"
_TEXTS = ("chunk_id", "source_file", "document_sha256", "section_id", "section_title", "section_path", "chunking_method")
_FRONT = " || '\n' || ".join(f"'{k}: ' || coalesce({f'to_json({c})::VARCHAR' if c in _TEXTS else f'{c}::VARCHAR'}, 'null')" for k, c in files.FRONT.items())
#: CTE un (doc, page, unit, ...): the units between headings and page starts, by windows over whole documents.
_LEVELS = range(1, 7)
_AFFECTED = {k: f"(chapter OR (section AND level <= {k}) OR (adopts AND open_level = {k}))" for k in _LEVELS}
_VALUES = {k: f"CASE WHEN adopts AND open_level = {k} THEN open || ' ' || line WHEN section AND level = {k} AND title IS NOT NULL THEN sid || ' ' || title END" for k in _LEVELS}
_BLANK = f"""NOT (right(before, 1) = '-' OR (regexp_matches(right(before, 1), '[{_C.CJK}]') AND regexp_matches(left(line, 1), '[{_C.CJK}]')) OR right(before, 1) IN ('（', '(', '[', '/')
            OR left(line, 1) IN ('，', '。', '；', '：', '、', '！', '？', ',', '.', '!', '?', ';', ':', ')', ']', '）', '/'))"""
_UNITS = f"""{_C.LINES}, {_REPEATED}, l2 AS (SELECT doc, page, (row_number() OVER (PARTITION BY doc, page ORDER BY n))::INT AS n, line FROM z LEFT JOIN rep USING (doc, key)
        WHERE NOT (margin AND (pages IS NOT NULL OR regexp_matches(line, '(?i)^(?:page[{_C.SPACE}]+)?[0-9]+$')))),
    u1 AS (SELECT *, regexp_matches(line, '{_C.CHAPTER}') AS chapter, regexp_matches(line, '{_C.SECTION}') AS sec FROM l2), u2 AS (SELECT *, sec AND NOT chapter AS section, sec OR chapter OR regexp_matches(line, '{_C.LIST_ITEM}') AS structural FROM u1),
    u3 AS (SELECT *, chapter OR section AS heading, CASE WHEN section THEN rtrim(regexp_extract(line, '{_C.SECTION}', 1), '.') END AS sid, CASE WHEN section THEN nullif(trim(regexp_extract(line, '{_C.SECTION}', 2)), '') END AS title FROM u2),
    u4 AS (SELECT *, len(sid) - len(replace(sid, '.', '')) + 1 AS level, count(*) FILTER (heading) OVER (PARTITION BY doc ORDER BY page, n) AS hg, (count(*) FILTER (heading OR n = 1) OVER (PARTITION BY doc, page ORDER BY n))::BIGINT AS unit FROM u3),
    u5 AS (SELECT *, max(CASE WHEN heading THEN sid END) OVER (PARTITION BY doc, hg) AS open, row_number() OVER k AS place, first_value(title) OVER k AS unit_title, first_value(chapter) OVER k AS of_chapter, lag(line) OVER k AS before FROM u4 WINDOW k AS (PARTITION BY doc, page, unit ORDER BY n)),
    u6 AS (SELECT *, len(open) - len(replace(open, '.', '')) + 1 AS open_level FROM u5),
    u7 AS (SELECT *, NOT structural AND place = 2 AND open IS NOT NULL AND open_level <= 2 AND unit_title IS NULL AND NOT of_chapter AND length(line) <= 120 AND NOT regexp_matches(line, '[。！？.!?]$') AS adopts FROM u6),
    u8 AS (SELECT *, count(*) FILTER (chapter) OVER d AS g0, {', '.join(f'count(*) FILTER ({_AFFECTED[k]}) OVER d AS g{k}' for k in _LEVELS)} FROM u7 WINDOW d AS (PARTITION BY doc ORDER BY page, n)),
    u9 AS (SELECT *, max(CASE WHEN chapter THEN line END) OVER (PARTITION BY doc, g0) AS t0, {', '.join(f'max({_VALUES[k]}) OVER (PARTITION BY doc, g{k}) AS t{k}' for k in _LEVELS)},
        CASE WHEN place = 1 THEN '' WHEN structural THEN chr(10) WHEN {_BLANK} THEN ' ' ELSE '' END || line AS piece FROM u8),
    u10 AS (SELECT doc, page, unit, arg_min(heading, n) AS heading, arg_min(chapter, n) AS chapter, max(CASE WHEN place = 1 THEN open END) AS section_id, max(CASE WHEN place = 1 THEN open_level END) AS level, max(CASE WHEN place = 1 THEN title END) AS title, arg_min(line, n) AS head,
        max(CASE WHEN adopts THEN line END) AS adopted, {', '.join(f'max(CASE WHEN place = 1 THEN t{k} END) AS t{k}' for k in range(7))}, min(n) AS start_line, max(n) AS end_line, string_agg(piece, '' ORDER BY n) AS text FROM u9 GROUP BY doc, page, unit),
    un AS (SELECT doc, page, unit, section_id, CASE WHEN chapter THEN head ELSE coalesce(adopted, title) END AS section_title,
        CASE WHEN chapter THEN head ELSE nullif(concat_ws(' > ', t0, {', '.join(f'CASE WHEN CASE WHEN heading OR adopted IS NOT NULL THEN level ELSE 99 END > {k} THEN t{k} END' for k in _LEVELS)}), '') END AS section_path, trim(text) AS text, start_line, end_line FROM u10)"""


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '^[{_C.SPACE}]+|[{_C.SPACE}]+$', '', 'g')"


def _parts(source: str) -> str:
    """CTEs that end in parts (k, part, body): the rows of source (k, body) above the limit cut into sentences and packed one segment after another."""
    tokens = _C.tokens
    return rf"""big AS (SELECT k, body FROM {source} WHERE {tokens('body')} > 650), ln AS (SELECT k, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS li FROM (SELECT k, regexp_split_to_array(body, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS x FROM big)),
    sp AS (SELECT k, li, string_split(regexp_replace(regexp_replace({_bare('line')}, '([.!?;])[{_C.SPACE}]+([A-Z0-9(])', '\1' || chr(1) || '\2', 'g'), '([。！？；!?;])', '\1' || chr(1), 'g'), chr(1)) AS x FROM ln),
    sx AS (SELECT k, li, unnest(range(1, len(x) + 1)) AS si, unnest(x) AS raw FROM sp), sg AS (SELECT k, li, si, {_bare('raw')} AS seg FROM sx),
    hs AS (SELECT k, li, si, 0 AS h, '' AS piece, seg AS rest FROM sg WHERE seg <> '' UNION ALL SELECT k, li, si, h + 1, {_bare('substr(rest, 1, e)')}, {_bare('substr(rest, e + 1)')} FROM (
        SELECT *, CASE WHEN tk <= 650 THEN length(rest) WHEN m > 0 THEN zs + m ELSE goal END AS e FROM (SELECT *, length(regexp_extract(substr(rest, zs + 1, goal - zs + 1), '(?s)^.*[。；;.，, ]')) AS m FROM (
        SELECT *, greatest(1, floor(goal * 0.7::DOUBLE)::INT) AS zs FROM (SELECT *, greatest(80, floor(length(rest) * (650::DOUBLE / tk))::INT) AS goal FROM (SELECT *, {tokens('rest')} AS tk FROM hs WHERE rest <> '')))))),
    sq AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY li, si, h) AS i, piece AS t, {tokens('piece')} AS s FROM hs WHERE piece <> ''), cn AS (SELECT k, max(i) AS n FROM sq GROUP BY k),
    pk AS (SELECT k, 0::BIGINT AS i, []::VARCHAR[] AS ct, []::INT[] AS cs, []::VARCHAR[] AS em FROM cn UNION ALL SELECT k, i, CASE WHEN list_sum(ns) >= 420 THEN [] ELSE nt END, CASE WHEN list_sum(ns) >= 420 THEN [] ELSE ns END,
            list_concat(CASE WHEN over THEN [array_to_string(ct, chr(10))] ELSE [] END, CASE WHEN list_sum(ns) >= 420 THEN [array_to_string(nt, chr(10))] ELSE [] END)
        FROM (SELECT k, i, ct, over, list_append(CASE WHEN over THEN list_slice(ct, -keep, -1) ELSE ct END, t) AS nt, list_append(CASE WHEN over THEN list_slice(cs, -keep, -1) ELSE cs END, s) AS ns
        FROM (SELECT pk.k, pk.i + 1 AS i, ct, cs, t, s, len(cs) > 0 AND coalesce(list_sum(cs), 0) + s > 650 AS over, greatest(1, len(list_filter(range(1, len(cs) + 1), lambda m: list_sum(list_slice(cs, -m, -1)) <= 70))) AS keep FROM pk JOIN sq ON sq.k = pk.k AND sq.i = pk.i + 1))),
    ot AS (SELECT k, i, unnest(range(1, len(em) + 1)) AS j, unnest(em) AS body FROM pk UNION ALL SELECT k, i + 1, 1, array_to_string(ct, chr(10)) FROM pk JOIN cn USING (k) WHERE i = n AND len(ct) > 0),
    parts AS (SELECT k, (row_number() OVER (PARTITION BY k ORDER BY i, j))::INT AS part, body FROM ot UNION ALL SELECT k, 1, body FROM {source} WHERE {tokens('body')} <= 650)"""


_CHUNKED = rf"""WITH RECURSIVE {_UNITS}, src AS (SELECT doc || chr(1) || page || chr(1) || unit AS k, text AS body FROM un WHERE text <> '' AND NOT regexp_matches(text, '{_C.CHAPTER}')
        AND NOT (regexp_matches(text, '{_C.SECTION}') AND NOT contains(text, chr(10)) AND {_C.tokens('text')} <= 35 AND NOT regexp_matches(text, '(?i)\b(?:must|should|required)\b|應|須|不得|禁止'))), {_parts('src')},
    fl AS (SELECT doc, page, coalesce(bool_or(n <= 20 AND (contains(replace(lower(line), 'ß', 'ss'), '目錄') OR regexp_matches(replace(lower(line), 'ß', 'ss'), '\bcontents\b'))), false) OR count(*) FILTER (contains(line, '...') OR contains(line, '……')) >= 3 AS seed,
        count(*) FILTER (regexp_matches(line, '{_C.SECTION}')) >= 4 AND sum(length(line)) / count(*) <= 55 AS likely FROM l2 GROUP BY doc, page), fg AS (SELECT doc, page, coalesce(seed, false) AS seed, coalesce(likely, false) AS likely FROM (SELECT DISTINCT doc, page FROM p) LEFT JOIN fl USING (doc, page)),
    fr AS (SELECT doc, page, seed AS contents FROM fg WHERE page = 1 UNION ALL SELECT fg.doc, fg.page, fg.seed OR (fr.contents AND fg.likely) FROM fr JOIN fg ON fg.doc = fr.doc AND fg.page = fr.page + 1),
    ck AS (SELECT doc, page, unit, part, body, section_id, section_title, section_path, start_line, end_line, (row_number() OVER (PARTITION BY doc, page ORDER BY unit, part))::INT AS chunk_index,
        CASE WHEN section_path IS NOT NULL AND section_title IS NOT NULL AND section_path <> section_title THEN section_path || ' > ' || section_title ELSE coalesce(section_path, section_title, '') END AS context FROM parts JOIN un ON k = doc || chr(1) || page || chr(1) || unit),
    rt AS (SELECT *, CASE WHEN context <> '' AND NOT contains(body, context) THEN context || chr(10) || body ELSE body END AS retrieval, regexp_replace(doc, '\.[^.]*$', '') AS stem FROM ck)
    SELECT stem || '_p' || page || '_c' || chunk_index AS chunk_id, stem || '_p' || page AS page_id, doc AS source_file, page, chunk_index, body AS text, retrieval AS retrieval_text, length(body)::INT AS text_length, {_C.tokens('retrieval')} AS estimated_tokens,
        section_id, section_title, section_path, contents AS is_table_of_contents, start_line, end_line, part AS split_part, 'regulatory_section_v1' AS chunking_method FROM rt JOIN fr USING (doc, page)"""
ORACLE = {
    "budget_split": f"WITH RECURSIVE src AS (SELECT doc_id AS k, text AS body FROM documents WHERE text IS NOT NULL), {_parts('src')} SELECT k AS doc_id, part, length(body)::INT AS length, {_C.tokens('body')} AS tokens FROM parts",
    "section_chunks": _CHUNKED,
    "section_units": f"WITH {_UNITS} SELECT doc, page, unit, section_id, section_title, section_path, text, start_line, end_line FROM un",
    "token_estimate": f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN {_C.tokens('text')} END AS tokens FROM documents",
    "chunk_tokens": f"WITH {_C.CHUNKS}, e AS (SELECT *, CASE WHEN retrieval_text IS NOT NULL THEN {_C.tokens('retrieval_text')} END AS tokens FROM c) SELECT chunk_id, tokens, tokens = estimated_tokens AS as_stored FROM e",
    "clean_lines": f"WITH {_C.LINES} SELECT doc, page, n, line FROM l",
    "repeated_margins": f"WITH {_C.LINES}, {_REPEATED} SELECT doc, key, pages FROM rep",
    "margin_removed_lines": f"""WITH {_C.LINES}, {_REPEATED} SELECT doc, page, (row_number() OVER (PARTITION BY doc, page ORDER BY n))::INT AS n, line FROM z LEFT JOIN rep USING (doc, key)
        WHERE NOT (margin AND (pages IS NOT NULL OR regexp_matches(line, '(?i)^(?:page[{_C.SPACE}]+)?[0-9]+$')))""",
    "contents_pages": f"""WITH RECURSIVE {_C.LINES}, f AS (SELECT doc, page, coalesce(bool_or(n <= 20 AND (contains(replace(lower(line), 'ß', 'ss'), '目錄') OR regexp_matches(replace(lower(line), 'ß', 'ss'), '\\bcontents\\b'))), false) OR count(*) FILTER (contains(line, '...') OR contains(line, '……')) >= 3 AS seed,
            count(*) FILTER (regexp_matches(line, '{_C.SECTION}')) >= 4 AND sum(length(line)) / count(*) <= 55 AS likely FROM l GROUP BY doc, page),
        g AS (SELECT doc, page, coalesce(seed, false) AS seed, coalesce(likely, false) AS likely FROM (SELECT DISTINCT doc, page FROM p) LEFT JOIN f USING (doc, page)),
        r AS (SELECT doc, page, seed AS contents FROM g WHERE page = 1 UNION ALL SELECT g.doc, g.page, g.seed OR (r.contents AND g.likely) FROM r JOIN g ON g.doc = r.doc AND g.page = r.page + 1)
        SELECT doc, page, contents FROM r""",
    "structural_lines": f"""WITH {_C.LINES}, k AS (SELECT *, regexp_matches(line, '{_C.CHAPTER}') AS chapter, regexp_matches(line, '{_C.SECTION}') AS sec FROM l),
        m AS (SELECT *, sec AND NOT chapter AS section FROM k WHERE sec OR chapter OR regexp_matches(line, '{_C.LIST_ITEM}')),
        o AS (SELECT *, CASE WHEN section THEN rtrim(regexp_extract(line, '{_C.SECTION}', 1), '.') END AS sid, CASE WHEN section THEN nullif(trim(regexp_extract(line, '{_C.SECTION}', 2)), '') END AS title FROM m)
        SELECT doc, page, n, chapter, section, sid, title, (len(sid) - len(replace(sid, '.', '')) + 1)::INT AS level FROM o""",
    "line_joins": f"""WITH {_C.LINES}, b AS (SELECT *, lag(line) OVER (PARTITION BY doc, page ORDER BY n) AS before FROM l)
        SELECT doc, page, n, NOT (right(before, 1) = '-' OR (regexp_matches(right(before, 1), '[{_C.CJK}]') AND regexp_matches(left(line, 1), '[{_C.CJK}]')) OR right(before, 1) IN ('（', '(', '[', '/')
            OR left(line, 1) IN ('，', '。', '；', '：', '、', '！', '？', ',', '.', '!', '?', ';', ':', ')', ']', '）', '/')) AS blank FROM b WHERE before IS NOT NULL""",
    "chunk_statistics": f"""WITH {_C.CHUNKS}, e AS (SELECT {_C.tokens("coalesce(retrieval_text, text, '')")} AS t, is_table_of_contents AS toc, section_id FROM c), s AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM e)
        SELECT count(*) AS n_chunks, count(*) FILTER (toc) AS n_contents, count(section_id) AS n_with_section, round(avg(t), 1) AS mean_tokens, max(t) AS max_tokens,
            (SELECT t FROM s WHERE i = n // 2) AS median_tokens, (SELECT t FROM s WHERE i = least(n - 1, floor(n * 0.95)::INT)) AS p95_tokens FROM e""",
    "chunk_files": f"WITH {_C.CHUNKS} SELECT chunk_id, {_FILE} AS file_name FROM c",
    "chunk_markdown": f"""WITH {_C.CHUNKS} SELECT {_safe("regexp_replace(source_file, '[.][^.]*$', '')")} AS document, {_FILE} AS file_name, '---\n' || {_FRONT} || '\n---\n\n# ' || chunk_id || '\n\n[Open source PDF at page ' || page || '](../../'
        || replace(url_encode(source_file), '%2F', '/') || '#page=' || page || ')\n\n## Retrieval Context\n\n' || coalesce(retrieval_text, '') || '\n\n## Source Text\n\n' || coalesce(text, '') || '\n' AS content FROM c""",
    "sample_chunk": f"WITH {_C.CHUNKS} SELECT chunk_id, text, section_path, '[' || source_file || ' p.' || page || ']' AS citation FROM c WHERE text IS NOT NULL AND NOT coalesce(is_table_of_contents, false) ORDER BY source_file, page, chunk_index, chunk_id LIMIT 1",
    "export_index": f"WITH {_C.CHUNKS} SELECT source_file, count(*) AS chunks, count(*) FILTER (is_table_of_contents) AS contents_chunks FROM c GROUP BY source_file",
}

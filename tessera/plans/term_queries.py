"""Queries on terms, their scores and their mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import naming
from tessera.operators import terms as T
from tessera.plans import sql
from tessera.plans.runtime import cut_lineage, read_table, spread
from tessera.sources import tables


def normalized_terms(spark: SparkSession, d: str) -> DataFrame:
    return tables.terms(spark, d).where("text IS NOT NULL").select("term_id", X.normalize_term(F.col("text")).alias("normalized_text"))


def term_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language, match type and id of each term from its normalised text."""
    rows = tables.terms(spark, d).select("term_id", "normalized_text", "concept_id")
    language = X.detect_language(F.col("normalized_text"))
    return rows.select("term_id", language.alias("language"), X.match_type(F.col("normalized_text"), language).alias("match_type"), X.stable_hash(14, F.col("concept_id"), F.col("normalized_text")).alias("hash14"))


def evidence_weights(spark: SparkSession, d: str) -> DataFrame:
    n = tables.chunks(spark, d).count()
    w = X.evidence_weight(F.col("ctfidf_score"), F.col("normalized_text"), F.col("chunk_frequency"), n)
    return tables.terms(spark, d).select("term_id", F.round(w, 6).alias("weight"))


def document_languages(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", X.detect_language(F.col("text")).alias("language"))


def valid_candidates(spark: SparkSession, d: str) -> DataFrame:
    return tables.terms(spark, d).where("normalized_text IS NOT NULL").select("term_id", T.valid_candidate(F.col("normalized_text")).alias("valid"), T.display_form(F.col("text"), F.col("normalized_text")).alias("shown"))


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return tables.chunks(spark, d, "source_file", "text").where("text IS NOT NULL").select("source_file", "chunk_id", "text")


def term_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = T.candidates(_bodies(spark, d), ["chunk_id"], "text")
    return rows.groupBy("chunk_id", "term").agg(F.sum("n").alias("n"))


def heading_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = T.heading_candidates(tables.chunks(spark, d, "section_title", "section_path"), ["chunk_id"])
    return rows.groupBy("chunk_id", "term").agg(F.sum("n").alias("n"))


def cluster_terms(spark: SparkSession, d: str) -> DataFrame:
    """Scored terms by language of the documents as the given clusters."""
    rows = read_table(spark, d, "documents").where("text IS NOT NULL").select(F.coalesce("lang", F.lit("none")).alias("cluster"), "doc_id", "text")
    return T.cluster_terms(T.candidate_table(spread(rows), "cluster", "text"), "cluster", None).select("cluster", "term", F.round("score", 6).alias("score"), "frequency", "chunk_frequency", "language")


def diverse_terms(spark: SparkSession, d: str) -> DataFrame:
    """The 12 best diverse terms by source file, headings first."""
    rows = tables.chunks(spark, d, "source_file", "text", "section_title", "section_path")
    table = T.group_table(rows, "source_file", "text")
    return T.with_fallback(T.diverse_terms(T.table_terms(table, "source_file"), "source_file"), table, "source_file")


def _mentions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = tables.terms(spark, d)
    return T.mentions(tables.chunks(spark, d, "text", "retrieval_text"), own.select("term_id", "text", "match_type")), own


def term_mentions(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d)[0].select("chunk_id", "term_id", "count", "source_count", "match_scope")


def name_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Where the names of leaf concepts occur in chunks, each part of a bilingual name by itself."""
    names = tables.concepts(spark, d).where("level = 2").select("concept_id", F.explode(F.split("name", " / ")).alias("text"))
    own = names.select(F.concat_ws("|", "concept_id", "text").alias("term_id"), "text", X.match_type(F.lower("text"), X.detect_language(F.col("text"))).alias("match_type"))
    return T.mentions(tables.chunks(spark, d, "text", "retrieval_text"), own).select("chunk_id", "term_id", "count", "source_count", "match_scope")


def _mined(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Mentions of the 12 best terms of each language of the documents, and these terms as nodes."""
    rows = read_table(spark, d, "documents").where("text IS NOT NULL").select(F.coalesce("lang", F.lit("none")).alias("cluster"), "doc_id", "text")
    best = T.cluster_terms(T.candidate_table(spread(rows), "cluster", "text"), "cluster", None).where(F.col("rank") <= T.TERMS)
    own = cut_lineage(best.select(F.concat_ws("|", "cluster", "term").alias("term_id"), F.col("cluster").alias("concept_id"), F.col("term").alias("text"), X.match_type(F.col("term"), F.col("language")).alias("match_type"), F.col("score").alias("evidence_weight")))
    return T.mentions(tables.chunks(spark, d, "text", "retrieval_text"), own.select("term_id", "text", "match_type")), own


def mined_mentions(spark: SparkSession, d: str) -> DataFrame:
    return _mined(spark, d)[0].select("chunk_id", "term_id", "count", "source_count", "match_scope")


def mined_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Languages (as concepts) that chunks mention by their terms."""
    rows = T.concept_mentions(*_mined(spark, d))
    return rows.select("chunk_id", "concept_id", "count", "source_count", F.size("matched_terms").alias("n_terms"), F.round("confidence", 5).alias("confidence"))


def concept_mentions(spark: SparkSession, d: str) -> DataFrame:
    found, own = _mentions(spark, d)
    rows = T.concept_mentions(found, own)
    return rows.select("chunk_id", "concept_id", "count", "source_count", F.size("matched_terms").alias("n_terms"), F.round("confidence", 6).alias("confidence"))


def concept_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The name each concept's best terms give it, before names are made unique."""
    own = tables.terms(spark, d).select("concept_id", "text", "normalized_text", "ctfidf_score")
    return naming.leaf_phrases(naming.phrases(own))


QUERIES = {f.__name__: f for f in (normalized_terms, term_languages, evidence_weights, document_languages, valid_candidates, term_candidates, heading_candidates, cluster_terms, diverse_terms, term_mentions, name_mentions, mined_mentions, mined_concepts, concept_mentions, concept_phrases)}

#: Fixed values of the checking SQL, stated apart from the operators' own.
_EN = (
    "('a', 'about', 'above', 'after', 'again', 'against', 'all', 'also', 'an', 'and', 'any', 'are', 'as', 'at', 'be', 'because', 'been', 'before', 'being', 'below', 'between', "
    "'both', 'but', 'by', 'can', 'could', 'do', 'does', 'doing', 'during', 'each', 'for', 'from', 'further', 'had', 'has', 'have', 'having', 'he', 'her', 'here', 'hers', 'him', "
    "'his', 'how', 'if', 'in', 'into', 'is', 'it', 'its', 'may', 'more', 'most', 'must', 'no', 'nor', 'not', 'of', 'on', 'once', 'only', 'or', 'other', 'our', 'out', 'over', "
    "'same', 'shall', 'should', 'so', 'some', 'such', 'than', 'that', 'the', 'their', 'them', 'then', 'there', 'these', 'they', 'this', 'those', 'through', 'to', 'under', 'until', "
    "'up', 'very', 'was', 'we', 'were', 'what', 'when', 'where', 'which', 'while', 'who', 'will', 'with', 'would', 'you', 'your')"
)
_ZH = (
    "('之', '了', '其', '及', '於', '與', '和', '一個', '一些', '一般', '不得', '以及', '任何', '但', '例如', '依據', '倘若', '其他', '其中', '則', '包括', '可以', '可能', '各', '同時', '因此', '如', '如果', '就', '應', '應當', "
    "'應該', '或', '所有', '所述', '按照', '根據', '此外', '然而', '為', '由', '的', '等', '而', '該', '該等', '這些', '這個', '進行', '須')"
)
_GENERIC = (
    "('applicable requirements', 'authorized institution', 'general requirements', 'introduction', 'overview', 'purpose', 'relevant requirements', 'the authority', "
    "'the institution', '引言', '目的', '概覽', '範圍', '上述規定', '下列各項', '以下各項', '有關規定', '本章', '本節', '本部分', '本段', '本指引', '該機構', '該認可機構')"
)


def _han(x: str) -> str:
    return f"regexp_matches({x}, '[{sql.CJK}]')"


def _language(x: str) -> str:
    return f"CASE WHEN {_han(x)} AND regexp_matches({x}, '[A-Za-z]') THEN 'mixed' WHEN {_han(x)} THEN 'zh' ELSE 'en' END"


def _valid(x: str) -> str:
    return f"""({x} <> '' AND {x} NOT IN {_GENERIC} AND length(replace({x}, ' ', '')) >= 2 AND length({x}) <= 80 AND NOT regexp_matches({x}, '^[0-9.\\-]+$')
        AND NOT ({_language(x)} = 'en' AND ((NOT contains({x}, ' ') AND length({x}) < 3) OR len(list_filter(string_split({x}, ' '), lambda w: w NOT IN {_EN})) = 0)) AND NOT ({_language(x)} = 'zh' AND {x} IN {_ZH}))"""


def _normal(x: str) -> str:
    kept = f"regexp_replace(regexp_replace(regexp_replace({sql.folded(x)}, '[^a-z0-9{sql.CJK}''\\- ]+', ' ', 'g'), ' +', ' ', 'g'), '^[-'' ]+|[-'' ]+$', '', 'g')"
    return f"(SELECT CASE WHEN {_han('v')} AND NOT regexp_matches(v, '[a-z0-9]') THEN replace(v, ' ', '') ELSE v END FROM (SELECT {kept} AS v))"


def _candidates(source: str, key: str, text: str) -> str:
    """CTEs that end in cand (key, term, n): the n-grams of the words between stop words."""
    return rf"""seg AS (SELECT {key}, row_number() OVER () AS sid, s FROM (SELECT {key}, unnest(regexp_split_to_array(coalesce({text}, ''), '[\n。！？!?；;：:]')) AS s FROM {source})),
    ew AS (SELECT {key}, sid, unnest(regexp_extract_all(s, '[A-Za-z][A-Za-z0-9]*(?:[-''][A-Za-z0-9]+)*')) AS w, generate_subscripts(regexp_extract_all(s, '[A-Za-z][A-Za-z0-9]*(?:[-''][A-Za-z0-9]+)*'), 1) AS i FROM seg),
    er AS (SELECT *, count(*) FILTER (lower(w) IN {_EN}) OVER (PARTITION BY sid ORDER BY i) AS run FROM ew),
    ek AS (SELECT *, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4 FROM er WHERE lower(w) NOT IN {_EN} WINDOW p AS (PARTITION BY sid, run ORDER BY i)),
    hr AS (SELECT {key}, row_number() OVER () AS rid, r FROM (SELECT {key}, unnest(regexp_extract_all(coalesce({text}, ''), '[{sql.CJK}]{{2,}}')) AS r FROM {source})),
    hw AS (SELECT {key}, rid, unnest(list_transform(range(1, length(r) + 1, 2), lambda j: substr(r, j, 2))) AS w, unnest(range(1, length(r) + 1, 2)) AS i FROM hr),
    hq AS (SELECT *, count(*) FILTER (w IN {_ZH}) OVER (PARTITION BY rid ORDER BY i) AS run FROM hw),
    hk AS (SELECT *, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM hq WHERE w NOT IN {_ZH} WINDOW p AS (PARTITION BY rid, run ORDER BY i)),
    grams AS (SELECT {key}, lower(w) AS term FROM ek UNION ALL SELECT {key}, lower(w || ' ' || w2) FROM ek WHERE w2 IS NOT NULL UNION ALL SELECT {key}, lower(w || ' ' || w2 || ' ' || w3) FROM ek WHERE w3 IS NOT NULL
        UNION ALL SELECT {key}, lower(w || ' ' || w2 || ' ' || w3 || ' ' || w4) FROM ek WHERE w4 IS NOT NULL UNION ALL SELECT {key}, w FROM hk UNION ALL SELECT {key}, w || w2 FROM hk WHERE w2 IS NOT NULL UNION ALL SELECT {key}, w || w2 || w3 FROM hk WHERE w3 IS NOT NULL),
    cand AS (SELECT {key}, term, count(*) AS n FROM grams WHERE {_valid('term')} GROUP BY {key}, term)"""


_SPACE = sql.SPACE
_NUMBER = rf"(?i)^(?:第[{_SPACE}]*[一二三四五六七八九十百0-9]+[{_SPACE}]*章[{_SPACE}]*[-—–:：]*[{_SPACE}]*|chapter[{_SPACE}]+[0-9]+[{_SPACE}]*[-—–:：]*[{_SPACE}]*|[0-9]+(?:\.[0-9]+){{0,6}}\.?[{_SPACE}]*)"
_MENTIONS = f"""{sql.CHUNKS}, {sql.TERMS}, fc AS (SELECT chunk_id, {sql.folded('coalesce(retrieval_text, text)')} AS r, {sql.folded("coalesce(text, '')")} AS s FROM c),
    ft AS (SELECT term_id, concept_id, match_type, evidence_weight, {sql.folded('text')} AS x FROM t WHERE text <> ''),
    pr AS (SELECT chunk_id, term_id, concept_id, match_type, evidence_weight, r, s, x FROM fc JOIN ft ON contains(r, x)),
    cnt AS (SELECT *, CASE WHEN match_type = 'word' THEN len(regexp_extract_all(r, '\\b' || regexp_escape(x) || '\\b')) ELSE (length(r) - length(replace(r, x, ''))) // length(x) END AS n,
        CASE WHEN match_type = 'word' THEN len(regexp_extract_all(s, '\\b' || regexp_escape(x) || '\\b')) ELSE (length(s) - length(replace(s, x, ''))) // length(x) END AS m FROM pr),
    mt AS (SELECT * FROM cnt WHERE n > 0)"""
_CLUSTERS = f"""b AS (SELECT coalesce(lang, 'none') || chr(1) || doc_id AS k, text FROM documents WHERE text IS NOT NULL), {_candidates('b', 'k', 'text')}, kc AS (SELECT split_part(k, chr(1), 1) AS cluster, term, n FROM cand),
        g AS (SELECT cluster, term, sum(n) AS frequency, count(*) AS chunk_frequency FROM kc GROUP BY ALL), e AS (SELECT term, sum(frequency) AS everywhere FROM g GROUP BY term), tt AS (SELECT cluster, sum(frequency) AS total FROM g GROUP BY cluster), av AS (SELECT sum(total)::DOUBLE / count(*) AS mean FROM tt), cterms AS (SELECT cluster, term, round(frequency::DOUBLE / greatest(total, 1) * ln(1 + mean / greatest(everywhere, 1)) * (1 + 0.12::DOUBLE * ln(1 + chunk_frequency)), 8) AS score, frequency::BIGINT AS frequency, chunk_frequency, {_language('term')} AS language
        FROM g JOIN e USING (term) JOIN tt USING (cluster), av WHERE chunk_frequency >= 2)"""
_MINED = f"""{_CLUSTERS}, {sql.CHUNKS}, rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, chunk_frequency DESC, term) AS rank FROM cterms),
    mn AS (SELECT cluster || '|' || term AS term_id, cluster AS concept_id, term AS x, CASE WHEN language = 'en' AND NOT contains(term, ' ') THEN 'word' ELSE 'phrase' END AS match_type, score AS w FROM rk WHERE rank <= 12),
    fd AS (SELECT chunk_id, {sql.folded('coalesce(retrieval_text, text)')} AS r, {sql.folded("coalesce(text, '')")} AS s FROM c), mq AS (SELECT * FROM fd JOIN mn ON contains(r, x)),
    mx AS (SELECT *, CASE WHEN match_type = 'word' THEN len(regexp_extract_all(r, '\\b' || regexp_escape(x) || '\\b')) ELSE (length(r) - length(replace(r, x, ''))) // length(x) END AS n,
        CASE WHEN match_type = 'word' THEN len(regexp_extract_all(s, '\\b' || regexp_escape(x) || '\\b')) ELSE (length(s) - length(replace(s, x, ''))) // length(x) END AS m FROM mq), mm AS (SELECT * FROM mx WHERE n > 0)"""
def _features(x: str) -> str:
    return f"list_distinct(CASE WHEN {_han(x)} THEN list_transform(range(1, greatest(length(replace({x}, ' ', '')) - 1, 1) + 1), lambda i: substr(replace({x}, ' ', ''), i, 2)) ELSE list_filter(string_split({x}, ' '), lambda w: w <> '') END)"


_PHRASES = f"""pr1 AS (SELECT concept_id, text, normalized_text AS normal, replace(normalized_text, ' ', '') AS bare, coalesce(ctfidf_score, 0) AS score, row_number() OVER (PARTITION BY concept_id ORDER BY coalesce(ctfidf_score, 0) DESC, normalized_text) AS place FROM t WHERE text IS NOT NULL AND normalized_text IS NOT NULL QUALIFY place <= 12),
    pr2 AS (SELECT a.concept_id, a.place, b.text AS wide, row_number() OVER (PARTITION BY a.concept_id, a.place ORDER BY b.score / greatest(a.score, 1e-12) + 0.08::DOUBLE * least(length(b.bare) - length(a.bare), 12) DESC, b.place) AS k FROM pr1 a JOIN pr1 b ON a.concept_id = b.concept_id
        WHERE contains(b.bare, a.bare) AND length(b.bare) <= 32 AND b.score / greatest(a.score, 1e-12) >= 0.55 AND b.score / greatest(a.score, 1e-12) + 0.08::DOUBLE * least(length(b.bare) - length(a.bare), 12) > 1.0),
    pr3 AS (SELECT pr1.*, coalesce(wide, text) AS phrase FROM pr1 LEFT JOIN (SELECT * FROM pr2 WHERE k = 1) USING (concept_id, place)), pr4 AS (SELECT *, {_normal('phrase')} AS x FROM pr3),
    pr5 AS (SELECT f.concept_id, s.phrase AS b, s.place FROM pr4 f JOIN pr4 s ON f.concept_id = s.concept_id AND f.place = 1 AND s.place BETWEEN 2 AND 8 WHERE length(f.bare) <= 4 AND s.score >= f.score * 0.65::DOUBLE AND NOT contains(f.x, s.x) AND NOT contains(s.x, f.x)
        AND len(list_intersect({_features('f.x')}, {_features('s.x')}))::DOUBLE / greatest(1, len(list_distinct(list_concat({_features('f.x')}, {_features('s.x')})))) < 0.35)"""
ORACLE = {
    "concept_phrases": f"WITH {sql.TERMS}, {_PHRASES} SELECT concept_id, concat_ws(' / ', phrase, (SELECT arg_min(b, pr5.place) FROM pr5 WHERE pr5.concept_id = pr4.concept_id)) AS name FROM pr4 WHERE place = 1",
    "normalized_terms": f"WITH {sql.TERMS} SELECT term_id, {_normal('text')} AS normalized_text FROM t WHERE text IS NOT NULL",
    "term_languages": f"""WITH {sql.TERMS} SELECT term_id, {_language("coalesce(normalized_text, '')")} AS language, CASE WHEN {_language("coalesce(normalized_text, '')")} = 'en' AND NOT contains(normalized_text, ' ') THEN 'word' ELSE 'phrase' END AS match_type,
        substr(sha256(concept_id || chr(31) || normalized_text), 1, 14) AS hash14 FROM t""",
    "evidence_weights": f"""WITH {sql.TERMS}, n AS (SELECT count(DISTINCT chunk_id) AS n FROM chunks) SELECT term_id, round(round(ctfidf_score * least(1, CASE WHEN {_han('normalized_text')} THEN length(replace(normalized_text, ' ', '')) / 4.0::DOUBLE
        ELSE len(list_filter(string_split(normalized_text, ' '), lambda w: w <> '')) / 2.0::DOUBLE END) * (ln((n + 1)::DOUBLE / (greatest(chunk_frequency, 1) + 1)) / ln((n + 1)::DOUBLE)), 8), 6) AS weight FROM t, n""",
    "document_languages": f"SELECT doc_id, {_language("coalesce(text, '')")} AS language FROM documents",
    "valid_candidates": f"""WITH {sql.TERMS}, s AS (SELECT term_id, normalized_text AS x, regexp_replace(trim(text), '^[ .,:;()\\[\\]{{}}—–-]+|[ .,:;()\\[\\]{{}}—–-]+$', '', 'g') AS o FROM t WHERE normalized_text IS NOT NULL)
        SELECT term_id, {_valid('x')} AS valid, CASE WHEN regexp_matches(o, '^[A-Z][A-Z0-9-]{{1,10}}$') THEN o ELSE x END AS shown FROM s""",
    "term_candidates": f"WITH {sql.CHUNKS}, b AS (SELECT chunk_id, text FROM c WHERE text IS NOT NULL), {_candidates('b', 'chunk_id', 'text')} SELECT chunk_id, term, n FROM cand",
    "heading_candidates": f"""WITH {sql.CHUNKS}, hd AS (SELECT chunk_id, unnest(list_distinct(list_filter(list_concat([section_title], coalesce(list_transform(string_split(section_path, '>'), lambda x: trim(x)), [])), lambda x: x IS NOT NULL))) AS h FROM c),
        hp AS (SELECT row_number() OVER () AS k, chunk_id, regexp_replace(regexp_replace(trim(regexp_replace(h, '[{_SPACE}]+', ' ', 'g')), '{_NUMBER}', ''), '^[ —–:：-]+|[ —–:：-]+$', '', 'g') AS heading FROM hd),
        hh AS (SELECT * FROM hp WHERE heading <> ''), wn AS (SELECT chunk_id, {_normal('heading')} AS term FROM hh), {_candidates('hh', 'k', 'heading')}
        SELECT chunk_id, term, sum(n)::BIGINT AS n FROM (SELECT chunk_id, term, 8 AS n FROM wn WHERE {_valid('term')} UNION ALL SELECT chunk_id, term, 4 * n FROM cand JOIN hh USING (k)) GROUP BY ALL""",
    "cluster_terms": f"WITH {_CLUSTERS} SELECT cluster, term, round(score, 6) AS score, frequency, chunk_frequency, language FROM cterms",
    "mined_mentions": f"WITH {_MINED} SELECT chunk_id, term_id, n::INT AS count, m::INT AS source_count, CASE WHEN m > 0 THEN 'source_text' ELSE 'section_context' END AS match_scope FROM mm",
    "mined_concepts": f"""WITH {_MINED}, tp AS (SELECT concept_id, max(w) AS top FROM mn GROUP BY concept_id), ag AS (SELECT chunk_id, concept_id, sum(n)::BIGINT AS count, sum(m)::BIGINT AS source_count, count(DISTINCT x)::INT AS n_terms, max(w) AS w FROM mm GROUP BY ALL)
        SELECT chunk_id, concept_id, count, source_count, n_terms, round(CASE WHEN top > 0 THEN w / top ELSE 0 END, 5) AS confidence FROM ag JOIN tp USING (concept_id) WHERE CASE WHEN top > 0 THEN w / top ELSE 0 END >= 0.45""",
    "term_mentions": f"WITH {_MENTIONS} SELECT chunk_id, term_id, n::INT AS count, m::INT AS source_count, CASE WHEN m > 0 THEN 'source_text' ELSE 'section_context' END AS match_scope FROM mt",
    "name_mentions": f"""WITH {sql.CHUNKS}, fc AS (SELECT chunk_id, {sql.folded('coalesce(retrieval_text, text)')} AS r, {sql.folded("coalesce(text, '')")} AS s FROM c), nm AS (SELECT DISTINCT concept_id || '|' || x AS term_id, {sql.folded('x')} AS x FROM (SELECT concept_id, unnest(string_split(name, ' / ')) AS x FROM concepts WHERE level = 2)),
        o AS (SELECT chunk_id, term_id, (length(r) - length(replace(r, x, ''))) // length(x) AS n, (length(s) - length(replace(s, x, ''))) // length(x) AS m FROM fc JOIN nm ON contains(r, x))
        SELECT chunk_id, term_id, n::INT AS count, m::INT AS source_count, CASE WHEN m > 0 THEN 'source_text' ELSE 'section_context' END AS match_scope FROM o""",
    "concept_mentions": f"""WITH {_MENTIONS}, top AS (SELECT concept_id, max(coalesce(evidence_weight, 0)) AS top FROM t GROUP BY concept_id), a AS (SELECT chunk_id, mt.concept_id, sum(n) AS count, sum(m) AS source_count, count(DISTINCT tx.text) AS n_terms, max(coalesce(mt.evidence_weight, 0)) AS w
        FROM mt JOIN (SELECT term_id, text FROM t) tx USING (term_id) GROUP BY ALL) SELECT chunk_id, concept_id, count::BIGINT AS count, source_count::BIGINT AS source_count, n_terms::INT AS n_terms, round(CASE WHEN top > 0 THEN w / top ELSE 0 END, 6) AS confidence FROM a JOIN top USING (concept_id) WHERE CASE WHEN top > 0 THEN w / top ELSE 0 END >= 0.45""",
}

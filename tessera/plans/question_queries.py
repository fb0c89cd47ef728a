"""Queries that answer questions: resolution, retrieval, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalize_question
from tessera.functions.vector import similarities
from tessera.operators import graph
from tessera.operators import retrieve as R
from tessera.plans import sql
from tessera.plans.graph_queries import _EDGES_ONLY, QUERY_WORD, evidence_edges
from tessera.plans.runtime import cut_lineage, read_table
from tessera.sources import tables
from tessera.sources.store import stored

QUESTION = "What are the requirements for monitoring the liquidity coverage data?"
WORDS = ("monitoring", "liquidity", "coverage", "data")  # the keywords of the question
CHUNK_LIMIT = 8


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """A question for every term."""
    own = tables.terms(spark, d).where("text IS NOT NULL").select("term_id", "text")
    return own.select(F.concat(F.lit("exact_"), "term_id").alias("question_id"), F.concat(F.lit("What is the control of "), "text", F.lit("?")).alias("question"))


def question_texts(spark: SparkSession, d: str) -> DataFrame:
    """Normalised form, intent and number of keywords of the held-out items and of the questions."""
    rows = read_table(spark, d, "eval_items").select(F.col("item_id").cast("string").alias("question_id"), F.col("text").alias("question")).unionByName(_questions(spark, d))
    return rows.select("question_id", F.sha2(normalize_question(F.col("question")), 256).alias("normalized_hash"), R.intent(F.col("question")).alias("intent"))


def query_keywords(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "eval_items").select("item_id", F.explode(R.keywords(F.col("text"))).alias("keyword"))
    return rows


def exact_terms(spark: SparkSession, d: str) -> DataFrame:
    own = tables.terms(spark, d)
    found = R.exact_matches(_questions(spark, d), own.select("term_id", "concept_id", "text", "match_type"))
    return R.grouped(found).select("question_id", "concept_id", "confidence", F.size("matched_terms").alias("n_terms"))


def fuzzy_terms(spark: SparkSession, d: str) -> DataFrame:
    """A question for every term with a spelling mistake in it (its fifth sign doubled), resolved by the ratio of matching blocks."""
    own = tables.terms(spark, d)
    asked = own.where("text IS NOT NULL").select(F.col("term_id").alias("question_id"), F.concat(F.lit("Where is "), F.substring("text", 1, 5), F.substring("text", 5, 1000)).alias("question"))
    found = R.fuzzy_matches(asked, own.select("term_id", "concept_id", "text", "match_type"))
    return R.fuzzy_decision(R.grouped(found)).select("question_id", "concept_id", "confidence", "status")


def semantic_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The resolver vectors of the leaf concepts as questions: best concepts by their best field, and the decision."""
    leaves = tables.concepts(spark, d).where("level = 2")
    fields = cut_lineage(R.concept_fields(leaves, tables.terms(spark, d)).where("vec IS NOT NULL").withColumn("field_id", F.concat_ws("|", "concept_id", "field", "text")))
    asked = leaves.where("resolver_embedding IS NOT NULL").select(F.col("concept_id").alias("question_id"), F.col("resolver_embedding").alias("q"))
    scores = similarities(asked, "question_id", "q", fields.select("field_id", "vec"), "field_id", "vec")
    out = R.semantic_decision(R.max_similarity(scores, fields))
    return out.select("question_id", "concept_id", "confidence", "rank", "status", "taken")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return tables.chunks(spark, d, "text", "retrieval_text", "source_file", "page", "chunk_index", "section_id", "section_path", "is_table_of_contents")


def concept_chunks(spark: SparkSession, d: str) -> DataFrame:
    ids = [r[0] for r in tables.concepts(spark, d).where("level = 2").select("concept_id").orderBy("concept_id").limit(2).collect()]
    rows = R.concept_chunks(evidence_edges(spark, d), _chunks(spark, d), ids, 200)
    return rows.select("chunk_id", "source_file", "page", "concept_score")


def lexical_chunks(spark: SparkSession, d: str) -> DataFrame:
    return R.lexical_chunks(_chunks(spark, d), list(WORDS), 200).select("chunk_id", "source_file", "page", "lexical_score")


def ranked_evidence(spark: SparkSession, d: str) -> DataFrame:
    """A question without a known term: keyword chunks, ranked, with their citations."""
    found = R.lexical_chunks(_chunks(spark, d), list(WORDS), max(25 * CHUNK_LIMIT, 100))
    return R.ranked(found, list(WORDS), "control_requirements", CHUNK_LIMIT).select("chunk_id", "relevance", "lexical_score", "citation", "section_id")


def concept_votes(spark: SparkSession, d: str) -> DataFrame:
    found = R.lexical_chunks(_chunks(spark, d), list(WORDS), 200)
    return R.concept_votes(found, evidence_edges(spark, d))


def graph_search(spark: SparkSession, d: str) -> DataFrame:
    concepts = tables.concepts(spark, d)
    reach = graph.two_hops(tables.taxonomy(spark, d), concepts.select("concept_id")).select("seed", "node")
    rows = R.search_graph(QUERY_WORD, concepts, tables.terms(spark, d), reach, evidence_edges(spark, d), _chunks(spark, d))
    return rows.select("chunk_id", F.array_join("concepts", "|").alias("concepts"), "citation")


def text_index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The stored postings of chunks outside contents pages, in folders by hash of the word, and (chunks, mean) of the indexed chunks."""
    chunks = lambda: tables.chunks(spark, d, "text", "retrieval_text", "is_table_of_contents").where(~F.coalesce("is_table_of_contents", F.lit(False)))
    # one task a folder and a sort inside, so a lookup reads few files
    made = lambda: R.postings(chunks()).withColumn("folder", R.index_folder(F.col("word"))).repartition("folder", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).sortWithinPartitions("folder", "word", "chunk_id")
    index = stored(spark, d, "postings", made, by="folder")
    sizes = stored(spark, d, "postings_size", lambda: index.groupBy("chunk_id").agg(F.max("length").alias("length")).agg(F.count("*").alias("chunks"), F.avg("length").alias("mean")))
    return index, sizes


def full_text_search(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over words and pairs of ideographs, outside contents pages. Only the folders of the question's words are read."""
    index, sizes = text_index(spark, d)
    size = sizes.first()
    words = spark.createDataFrame([(w,) for w in WORDS], "word string").select(R.index_folder(F.col("word"))).distinct().collect()
    return R.full_text(index.where(F.col("folder").isin([r[0] for r in words])), list(WORDS), size[0], size[1] or 1.0, 20)


def contains_search(spark: SparkSession, d: str) -> DataFrame:
    """The scan used where there is no index, in a stated order."""
    rows = _chunks(spark, d).where(~F.coalesce("is_table_of_contents", F.lit(False)) & F.lower(F.coalesce("retrieval_text", "text")).contains("liquidity coverage data"))
    return R.with_citation(rows).orderBy("source_file", "page", "chunk_id").limit(50).select("chunk_id", "citation")


def answer(spark: SparkSession, d: str) -> DataFrame:
    """The whole policy for three questions, each a row of JSON: one without a known term, one that names a term, one that only a vector resolves."""
    from tessera.plans.answer import answer as run

    named = tables.terms(spark, d).where("length(text) >= 8").agg(F.min_by("text", "term_id")).first()[0]
    vector = tables.concepts(spark, d).where("level = 2 AND resolver_embedding IS NOT NULL").agg(F.min_by("resolver_embedding", "concept_id")).first()[0]
    out = run(spark, d, QUESTION)
    if named:
        out = out.unionByName(run(spark, d, f"What must be done about {named}?"))
    if vector:
        out = out.unionByName(run(spark, d, "Which of them applies here?", encode=lambda text: vector))
    return out


QUERIES = {f.__name__: f for f in (question_texts, query_keywords, exact_terms, fuzzy_terms, semantic_candidates, concept_chunks, lexical_chunks, ranked_evidence, concept_votes, graph_search, full_text_search, contains_search, answer)}

_PUNCTUATION = r"\p{P}"


def _plain(x: str) -> str:
    return f"replace(replace(trim(regexp_replace(regexp_replace({sql.folded(x)}, '{_PUNCTUATION}', ' ', 'g'), '[{sql.SPACE}]+', ' ', 'g')), '身份', '身分'), '帳戶', '戶口')"


_ASKED = f"""{sql.TERMS}, asked AS (SELECT 'exact_' || term_id AS question_id, 'What is the control of ' || text || '?' AS question FROM t WHERE text IS NOT NULL)"""
_INTENT = """CASE WHEN regexp_matches(z, 'control|requirement|required|must|should|控制|措施|要求|規定|必須|應當|須要') THEN 'control_requirements' WHEN regexp_matches(z, 'compare|comparison|difference|versus|vs|比較|分別|差異|區別') THEN 'comparison'
    WHEN regexp_matches(z, 'what is|define|definition|meaning|甚麼是|什麼是|定義|意思') THEN 'definition' WHEN regexp_matches(z, 'how to|process|procedure|steps|如何|程序|流程|步驟') THEN 'procedure' ELSE 'general_information' END"""
_LOW = "lower(coalesce(retrieval_text, text))"
_LEX = f"lx AS (SELECT *, {' + '.join(f'''contains({_LOW}, '{w}')::INT''' for w in WORDS)} AS lexical_score FROM c WHERE NOT coalesce(is_table_of_contents, false)), lc AS (SELECT * FROM lx WHERE lexical_score > 0 ORDER BY lexical_score DESC, source_file, page, chunk_id LIMIT 200)"
_STOPPED = """list_transform(list_filter(string_split(z, ' '), lambda w: NOT regexp_full_match(w, '|a|an|and|are|controls?|for|how|is|must|of|required|requirements?|should|the|to|what|which')), lambda w: {})"""
_CUT = "replace(replace(replace(replace(replace(replace(replace(replace(w, '有哪些', ' '), '如何', ' '), '甚麼', ' '), '什麼', ' '), '控制', ' '), '措施', ' '), '要求', ' '), '規定', ' ')"
_SCORE = (
    "60 * lexical_score"
    + "".join(f" + 100 * contains(z, '{w}')::INT" for w in WORDS)
    + "".join(f" + 10 * least(3, len(regexp_extract_all(z, '{w}')))" for w in ("control", "requirement", "required", "must", "should", "控制", "措施", "要求", "規定", "必須"))
    + " + 150 * len(list_filter(['include the following', 'includes the following', 'requirements are', 'should include', '以下為', '包括以下', '應包括', '應採取以下', '措施如下'], lambda p: contains(substr(z, 1, 500), p)))"
    + " + 120 * len(list_filter(['general requirements', 'overall requirements', 'overview', '何謂', '一般規定', '基本規定'], lambda p: contains(substr(z, 1, 300), p)))"
    + " - 1000 * contains(substr(z, 1, 200), '目錄')::INT"
)
_CITE = "'[' || coalesce(source_file, 'unknown source') || ' p.' || coalesce(page::VARCHAR, '?') || ']'"
#: CTEs c, t, ce, cm and ee: the concept edges of chunks of either type.
_EVIDENCE = f"{sql.MENTIONED}, {_EDGES_ONLY}, ee AS (SELECT chunk_id, concept_id, max(confidence) AS confidence FROM (SELECT * FROM ce UNION ALL SELECT * FROM cm) GROUP BY ALL)"
ORACLE = {
    "question_texts": f"""WITH {_ASKED}, a AS (SELECT item_id::VARCHAR AS question_id, text AS question FROM eval_items UNION ALL SELECT * FROM asked), b AS (SELECT question_id, {_plain('question')} AS y FROM a), k AS (SELECT *, ' ' || y || ' ' AS z FROM b)
        SELECT question_id, sha256(y) AS normalized_hash, {_INTENT} AS intent FROM k""",
    "query_keywords": f"""WITH a AS (SELECT item_id, {_plain('text')} AS z FROM eval_items), b AS (SELECT item_id, unnest(list_filter(flatten(list_transform({_STOPPED.format(_CUT)}, lambda w: string_split(w, ' '))), lambda w: length(w) >= 2)) AS w FROM a)
        SELECT DISTINCT item_id, keyword FROM (SELECT item_id, w AS keyword FROM b UNION ALL SELECT item_id, unnest(list_transform(range(1, length(w)), lambda i: substr(w, i, 2))) FROM b WHERE length(w) >= 4 AND regexp_full_match(w, '[{sql.CJK}]+'))""",
    "exact_terms": f"""WITH {_ASKED}, q AS (SELECT question_id, {_plain('question')} AS z FROM asked), n AS (SELECT term_id, concept_id, match_type, {_plain('text')} AS x FROM t WHERE text IS NOT NULL),
        m AS (SELECT question_id, concept_id, CASE WHEN match_type = 'word' THEN 0.98 ELSE 1.0 END AS s FROM q JOIN n ON x <> '' AND contains(z, x) AND (match_type <> 'word' OR regexp_matches(z, '\\b' || regexp_escape(x) || '\\b')))
        SELECT question_id, concept_id, round(least(1, max(s) + 0.02 * (count(*) - 1)), 4)::DOUBLE AS confidence, count(*)::INT AS n_terms FROM m GROUP BY ALL""",
    "semantic_candidates": f"""WITH {sql.TERMS}, k AS (SELECT DISTINCT concept_id, name, resolver_embedding FROM concepts WHERE level = 2), tt AS (SELECT t.concept_id, text, t.resolver_embedding AS v, row_number() OVER (PARTITION BY t.concept_id ORDER BY ctfidf_score DESC, term_id) AS n FROM t),
        f AS (SELECT concept_id, 0 AS n, name AS text, resolver_embedding AS v FROM k UNION ALL SELECT concept_id, n, text, v FROM tt WHERE n <= 12 AND concept_id IN (SELECT concept_id FROM k)),
        u AS (SELECT * FROM f WHERE trim(coalesce(text, '')) <> '' QUALIFY row_number() OVER (PARTITION BY concept_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[{sql.SPACE}]+', ' ', 'g')) ORDER BY n) = 1),
        s AS (SELECT k.concept_id AS question_id, u.concept_id, max(round({sql.unit_dot('k.resolver_embedding', 'u.v')} - CASE WHEN n > 0 THEN 0.03::DOUBLE ELSE 0 END, 6)) AS confidence FROM k, u WHERE u.v IS NOT NULL AND k.resolver_embedding IS NOT NULL GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC, concept_id) AS rank FROM s QUALIFY rank <= 5), b AS (SELECT *, max(confidence) OVER w AS best, max(confidence) FILTER (rank = 2) OVER w AS second FROM r WINDOW w AS (PARTITION BY question_id)),
        g AS (SELECT *, CASE WHEN best < 0.5 THEN 'unresolved' WHEN round(best - second, 6) < 0.06 THEN 'ambiguous' ELSE 'resolved' END AS status FROM b)
        SELECT question_id, concept_id, confidence, rank::INT AS rank, status, status = 'resolved' AND rank <= 1 AND confidence >= 0.5 AS taken FROM g""",
    "concept_chunks": f"WITH {_EVIDENCE} SELECT chunk_id, source_file, page, max(confidence) AS concept_score FROM ee JOIN c USING (chunk_id) WHERE concept_id IN (SELECT DISTINCT concept_id FROM concepts WHERE level = 2 ORDER BY concept_id LIMIT 2) GROUP BY ALL ORDER BY concept_score DESC, source_file, page, chunk_id LIMIT 200",
    "lexical_chunks": f"WITH {sql.CHUNKS}, {_LEX} SELECT chunk_id, source_file, page, lexical_score FROM lc",
    "ranked_evidence": f"WITH {sql.CHUNKS}, {_LEX}, z AS (SELECT *, {_plain('coalesce(retrieval_text, text)')} AS z FROM lc) SELECT chunk_id, ({_SCORE})::INT AS relevance, lexical_score, {_CITE} AS citation, section_id FROM z ORDER BY relevance DESC, source_file, page, chunk_id LIMIT 8",
    "concept_votes": f"WITH {_EVIDENCE}, {_LEX}, v AS (SELECT concept_id, sum(lexical_score)::BIGINT AS vote FROM lc JOIN ee USING (chunk_id) GROUP BY concept_id) SELECT concept_id, vote, round(vote::DOUBLE / sum(vote) OVER (), 4) AS confidence FROM v ORDER BY vote DESC, concept_id LIMIT 5",
    "graph_search": f"""WITH RECURSIVE {_EVIDENCE}, e AS (SELECT DISTINCT parent_concept_id AS a, child_concept_id AS b FROM taxonomy_edges), r AS (SELECT DISTINCT concept_id AS node, 0 AS depth FROM concepts k WHERE contains(lower(name), '{QUERY_WORD}') OR contains(concept_id, '{QUERY_WORD}')
            OR EXISTS (SELECT 1 FROM t WHERE t.concept_id = k.concept_id AND contains(lower(t.text), '{QUERY_WORD}')) UNION ALL SELECT b, depth + 1 FROM r JOIN e ON node = a WHERE depth < 2),
        n AS (SELECT DISTINCT concept_id, name FROM concepts WHERE concept_id IN (SELECT node FROM r)), h AS (SELECT chunk_id, list_sort(list(DISTINCT name)) AS names FROM ee JOIN n USING (concept_id) GROUP BY chunk_id)
        SELECT chunk_id, array_to_string(names, '|') AS concepts, {_CITE} AS citation FROM h JOIN c USING (chunk_id) ORDER BY len(names) DESC, source_file, page, chunk_index, chunk_id LIMIT 8""",
    "full_text_search": f"""WITH {sql.CHUNKS}, b AS (SELECT chunk_id, lower(coalesce(retrieval_text, text, '')) AS x FROM c WHERE NOT coalesce(is_table_of_contents, false)), w AS (SELECT chunk_id, unnest(regexp_extract_all(x, '[a-z0-9]+')) AS word FROM b
            UNION ALL SELECT chunk_id, unnest(list_transform(range(1, length(r)), lambda i: substr(r, i, 2))) FROM (SELECT chunk_id, unnest(regexp_extract_all(x, '[{sql.CJK}]{{2,}}')) AS r FROM b)),
        p AS (SELECT chunk_id, word, count(*) AS n FROM w GROUP BY ALL), l AS (SELECT chunk_id, sum(n) AS length FROM p GROUP BY chunk_id), a AS (SELECT count(*)::DOUBLE AS total, avg(length) AS mean FROM l), f AS (SELECT word, count(*) AS df FROM p WHERE word IN {tuple(WORDS)} GROUP BY word)
        SELECT chunk_id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM p JOIN f USING (word) JOIN l USING (chunk_id), a GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 20""",
    "contains_search": f"WITH {sql.CHUNKS} SELECT chunk_id, {_CITE} AS citation FROM c WHERE NOT coalesce(is_table_of_contents, false) AND contains({_LOW}, 'liquidity coverage data') ORDER BY source_file, page, chunk_id LIMIT 50",
}

"""Queries on nodes, edges, facts and counts of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.vector import similarities
from tessera.operators import assign, facts, graph, terms
from tessera.plans import sql
from tessera.plans.runtime import cut_lineage, read_table
from tessera.sources import tables
from tessera.sources.store import stored

QUERY_WORD = "limit"


def about(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, concept_id, semantic_similarity, confidence): each chunk with a usable vector and its most similar leaf concept."""

    def make() -> DataFrame:
        leaves = tables.concepts(spark, d).where("level = 2").select("concept_id", F.col("embedding").alias("vector"))
        chunks = tables.chunks(spark, d, "embedding").where("embedding IS NOT NULL")
        return assign.primary(chunks, "chunk_id", "embedding", leaves, "concept_id", "vector")

    return stored(spark, d, "about", make)


def concept_edges(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, concept_id, confidence): the most similar leaf concept of each chunk, and the second where it is near (0.5 or more)."""

    def make() -> DataFrame:
        own = about(spark, d).select("chunk_id", "concept_id", "confidence")
        leaves = tables.concepts(spark, d).where("level = 2 AND embedding IS NOT NULL").select("concept_id", F.col("embedding").alias("vector"))
        chunks = tables.chunks(spark, d, "embedding").where("embedding IS NOT NULL")
        two = similarities(chunks, "chunk_id", "embedding", leaves, "concept_id", "vector", top=2).where(F.round("similarity", 6) >= 0.5)
        second = two.join(own.select("chunk_id", "concept_id"), ["chunk_id", "concept_id"], "left_anti")
        return own.unionByName(second.select("chunk_id", "concept_id", F.round(F.col("similarity") * 0.8, 6).alias("confidence")))

    return stored(spark, d, "concept_edges", make)


def evidence_edges(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, concept_id, confidence) of either edge type: by vector or by mentions, the surer one where there are both."""

    def make() -> DataFrame:
        own = tables.terms(spark, d)
        found = terms.mentions(tables.chunks(spark, d, "text", "retrieval_text"), own.select("term_id", "text", "match_type"))
        mentioned = terms.concept_mentions(found, own).select("chunk_id", "concept_id", F.round("confidence", 6).alias("confidence"))
        return concept_edges(spark, d).unionByName(mentioned).groupBy("chunk_id", "concept_id").agg(F.max("confidence").alias("confidence"))

    return stored(spark, d, "evidence_edges", make)


def document_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.document_nodes(graph.require_unique(tables.documents(spark, d), "document_id"))


def page_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.page_nodes(tables.chunks(spark, d, "page_id", "source_file", "page", "is_table_of_contents"))


def containment_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.page_edges(tables.chunks(spark, d, "page_id", "source_file"))


def bound_document_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges from documents to chunks both of whose ends are stored."""
    chunks = tables.chunks(spark, d, "source_file")
    edges = chunks.select(F.col("source_file").alias("document_id"), "chunk_id")
    return graph.bound_edges(edges, tables.documents(spark, d), "document_id", chunks, "chunk_id")


def next_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.next_edges(tables.chunks(spark, d, "source_file", "page", "chunk_index"))


def upserted_documents(spark: SparkSession, d: str) -> DataFrame:
    """First loads updated by the later loads of the same document; created_at stays."""
    rows = read_table(spark, d, "source_documents").where("document_id IS NOT NULL").select("document_id", "sha256", "created_at", "updated_at")
    n = F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("updated_at").asc_nulls_first(), F.xxhash64("sha256", "created_at")))
    rows = rows.withColumn("n", n).withColumn("last", F.max("n").over(Window.partitionBy("document_id")))
    first, later = rows.where("n = 1").drop("n", "last"), rows.where("n > 1 AND n = last").drop("n", "last")
    return graph.upsert(first, later, ["document_id"], once=("created_at",)).select("document_id", F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us"))


def graph_verification(spark: SparkSession, d: str) -> DataFrame:
    chunks = cut_lineage(tables.chunks(spark, d, "source_file", "page_id", "page", "chunk_index", "is_table_of_contents", "section_id"))
    documents, named, concepts = tables.documents(spark, d), tables.terms(spark, d), tables.concepts(spark, d)
    count = F.count("*")
    return graph.metrics(
        documents=(documents, count), chunks=(chunks, count), pages=(chunks, F.countDistinct("page_id")), contents_chunks=(chunks, F.count_if("is_table_of_contents")), section_chunks=(chunks, F.count("section_id")),
        next_edges=(graph.next_edges(chunks), count), concepts=(concepts, count), leaf_concepts=(concepts, F.count_if(F.col("level") == 2)), terms=(named, count),
        normalized_to=(named.join(concepts, "concept_id", "left_semi"), count), taxonomy_edges=(tables.taxonomy(spark, d), count),
    )


def semantic_counts(spark: SparkSession, d: str) -> DataFrame:
    """Nodes a semantic load would replace."""
    return graph.label_counts(Concept=tables.concepts(spark, d), Term=tables.terms(spark, d))


def induction_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that terms and topics are learned from."""
    rows = tables.chunks(spark, d, "text", "retrieval_text", "source_file", "page", "chunk_index", "is_table_of_contents").where(F.col("text").isNotNull() & ~F.coalesce("is_table_of_contents", F.lit(False)))
    return rows.select("chunk_id", F.sha2(F.coalesce("retrieval_text", "text"), 256).alias("body_hash"), "source_file", "page", "chunk_index").orderBy("source_file", "page", "chunk_index", "chunk_id")


def registered_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms with the name of their concept, of all runs."""
    names = tables.concepts(spark, d).select("concept_id", F.col("name").alias("concept_name"))
    return tables.terms(spark, d).join(names, "concept_id").select("term_id", F.col("text").alias("term_text"), "match_type", "concept_id", "concept_name")


def latest_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Leaf concepts of the latest run of terms, with their 12 best terms of that run in order."""
    own = tables.terms(spark, d).where("text IS NOT NULL")
    last = graph.latest_run(own, "run_id", "updated_at")
    order = Window.partitionBy("concept_id").orderBy(F.desc("ctfidf_score"), "term_id")
    top = own.join(F.broadcast(last), "run_id", "left_semi").withColumn("n", F.row_number().over(order)).where("n <= 12")
    listed = top.groupBy("concept_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda s: s["text"]), "|").alias("term_fields"))
    return tables.concepts(spark, d).where("level = 2").join(listed, "concept_id", "left").select("concept_id", "name", "description", "term_fields").orderBy("concept_id")


def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    """The run that was written last among the terms, and among the concepts' edges none has a time, so of the terms only."""
    return graph.latest_run(tables.terms(spark, d), "run_id", "updated_at")


def cleared_provenance(spark: SparkSession, d: str) -> DataFrame:
    """What a load that replaces the provenance layer removes and what it leaves: every table by its layer."""
    return graph.cleared(_layers(spark, d), "provenance")


def cleared_semantics(spark: SparkSession, d: str) -> DataFrame:
    return graph.cleared(_layers(spark, d), "semantic")


def _layers(spark: SparkSession, d: str) -> dict[str, tuple[str, DataFrame]]:
    chunks = tables.chunks(spark, d, "source_file", "page_id")
    return {
        "Document": ("provenance", tables.documents(spark, d)), "Page": ("provenance", chunks.select("page_id").distinct()), "Chunk": ("provenance", chunks),
        "Concept": ("semantic", tables.concepts(spark, d)), "Term": ("semantic", tables.terms(spark, d)), "HAS_SUBCONCEPT": ("semantic", tables.taxonomy(spark, d)), "ABOUT_CONCEPT": ("semantic", about(spark, d)),
    }


def leaf_concepts(spark: SparkSession, d: str) -> DataFrame:
    return tables.concepts(spark, d).where("level = 2").select("concept_id", "name", "category").orderBy("concept_id")


def two_hops(spark: SparkSession, d: str) -> DataFrame:
    return graph.two_hops(tables.taxonomy(spark, d), tables.concepts(spark, d).select("concept_id"))


def named_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Concepts that a word names by their name or by one of their terms."""
    concepts = tables.concepts(spark, d)
    own = tables.terms(spark, d).where(F.lower("text").contains(QUERY_WORD)).select("concept_id")
    by_name = concepts.where(F.lower("name").contains(QUERY_WORD))
    return by_name.select("concept_id").unionByName(concepts.join(own, "concept_id", "left_semi").select("concept_id")).distinct()


def _facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Accepted candidates, facts with a review by rule, supports, chunks."""
    chunks = tables.chunks(spark, d, "text", "source_file", "page", "chunk_index")
    edges = cut_lineage(concept_edges(spark, d))
    held = edges.groupBy("chunk_id").agg(F.array_sort(F.collect_set("concept_id")).alias("concept_ids"))
    found = cut_lineage(facts.valid(facts.cooccurrences(chunks.join(held, "chunk_id")), chunks, edges))
    nodes = facts.fact_nodes(found)
    # a review: facts whose id ends in 0-7 are approved, in 8-b rejected, the rest stay pending
    last = F.right("fact_id", F.lit(1))
    changes = nodes.select("fact_id", F.when(last.between("0", "7"), "approved").when(last.isin("8", "9", "a", "b"), "rejected").alias("new_status"))
    return found, facts.set_status(nodes, changes), facts.supports(found), chunks


def cooccurrence_facts(spark: SparkSession, d: str) -> DataFrame:
    found = _facts(spark, d)[0]
    return found.select("chunk_id", "subject_concept_id", "object_concept_id", F.sha2("evidence_quote", 256).alias("quote_hash"), "confidence")


def reviewed_facts(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d)[1].select("fact_id", "subject_concept_id", "predicate", "object_concept_id", "status")


def pending_review(spark: SparkSession, d: str) -> DataFrame:
    _, nodes, supports, chunks = _facts(spark, d)
    rows = facts.pending(nodes, supports, chunks, 20)
    return rows.select("fact_id", "confidence", "evidence_count", F.array_join(F.transform("evidence", lambda e: e["chunk_id"]), ",").alias("evidence_chunks"))


def stored_again(spark: SparkSession, d: str) -> DataFrame:
    """Facts extracted again over the reviewed ones: no status changes."""
    found, nodes, _, _ = _facts(spark, d)
    return facts.write_facts(nodes, found).groupBy("status").agg(F.count("*").alias("n"))


def unsupported_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with a concept and no fact: those with one concept only, and blank ones."""
    _, _, supports, chunks = _facts(spark, d)
    rows = facts.unsupported_chunks(chunks, concept_edges(spark, d), supports)
    return rows.select("chunk_id", F.array_join("concept_ids", ",").alias("concept_ids"))


def approved_facts(spark: SparkSession, d: str) -> DataFrame:
    """Approved facts of the first three leaf concepts, with up to three quotes."""
    _, nodes, supports, chunks = _facts(spark, d)
    ids = [r[0] for r in tables.concepts(spark, d).where("level = 2").select("concept_id").orderBy("concept_id").limit(3).collect()]
    rows = facts.approved(nodes, supports, chunks, ids, 8)
    return rows.select("fact_id", "subject_concept_id", "object_concept_id", F.size("quotes").alias("n_quotes"))


def fact_search(spark: SparkSession, d: str) -> DataFrame:
    _, nodes, supports, chunks = _facts(spark, d)
    rows = facts.search_facts(QUERY_WORD, nodes, tables.concepts(spark, d), supports, chunks, 8)
    return rows.select("fact_id", "chunk_id", "subject", "object", "citation")


def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return graph.fingerprint(tables.chunks(spark, d, "source_file", "page", "chunk_index", "text", "retrieval_text"))


QUERIES = {
    f.__name__: f
    for f in (
        about, document_nodes, page_nodes, containment_edges, bound_document_edges, next_edges, upserted_documents, graph_verification, semantic_counts, cleared_provenance, cleared_semantics, induction_chunks, registered_terms, latest_concepts, latest_runs, evidence_edges, leaf_concepts, two_hops,
        named_concepts, cooccurrence_facts, reviewed_facts, pending_review, stored_again, unsupported_chunks, approved_facts, fact_search, corpus_fingerprint,
    )
}
_NEXT = "nx AS (SELECT chunk_id, lead(chunk_id) OVER (PARTITION BY source_file ORDER BY page, chunk_index, chunk_id) AS next_id FROM c QUALIFY next_id IS NOT NULL)"
_EDGES_ONLY = sql.ABOUT.partition(", sims AS")[1][2:] + sql.ABOUT.partition(", sims AS")[2] + ", ce AS (SELECT chunk_id, concept_id, confidence FROM about UNION ALL SELECT chunk_id, concept_id, round(raw * 0.8, 6) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY s DESC, concept_id) AS n FROM sims) WHERE n = 2 AND s >= 0.5)"
_EDGES = sql.CHUNKS + ", " + _EDGES_ONLY
_LAYERS = """ly AS (SELECT 'Document' AS label, 'provenance' AS layer, count(DISTINCT document_id) AS n FROM source_documents UNION ALL SELECT 'Page', 'provenance', count(DISTINCT page_id) + count(DISTINCT CASE WHEN page_id IS NULL THEN 1 END) FROM c
    UNION ALL SELECT 'Chunk', 'provenance', count(*) FROM c UNION ALL SELECT 'Concept', 'semantic', count(DISTINCT concept_id) FROM concepts UNION ALL SELECT 'Term', 'semantic', count(DISTINCT term_id) FROM terms
    UNION ALL SELECT 'HAS_SUBCONCEPT', 'semantic', count(*) FROM (SELECT DISTINCT parent_concept_id, child_concept_id FROM taxonomy_edges)
    UNION ALL SELECT 'ABOUT_CONCEPT', 'semantic', count(*) FROM c WHERE len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0)"""
_FACTS = (
    _EDGES
    + """, q AS (SELECT chunk_id, source_file, page, substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 500) AS quote FROM c WHERE regexp_matches(coalesce(text, ''), '\\S')),
    cand AS (SELECT q.chunk_id, a.concept_id AS s, b.concept_id AS o, quote, source_file, page FROM q JOIN ce a USING (chunk_id) JOIN ce b ON b.chunk_id = q.chunk_id AND a.concept_id < b.concept_id),
    sup AS (SELECT DISTINCT chunk_id, 'fact_' || substr(sha256(lower(s || '|RELATED_TO|' || o)), 1, 24) AS fact_id, quote, source_file, page FROM cand),
    fa AS (SELECT DISTINCT 'fact_' || substr(sha256(lower(s || '|RELATED_TO|' || o)), 1, 24) AS fact_id, s AS subject_concept_id, 'RELATED_TO' AS predicate, o AS object_concept_id FROM cand),
    f AS (SELECT *, CASE WHEN right(fact_id, 1) BETWEEN '0' AND '7' THEN 'approved' WHEN right(fact_id, 1) IN ('8', '9', 'a', 'b') THEN 'rejected' ELSE 'pending' END AS status FROM fa)"""
)
ORACLE = {
    "about": f"WITH {sql.ABOUT} SELECT chunk_id, concept_id, semantic_similarity, confidence FROM about",
    "document_nodes": f"WITH {sql.DOCUMENTS} SELECT document_id, file_name, source_stem, sha256 FROM d",
    "page_nodes": f"WITH {sql.CHUNKS} SELECT page_id, min(source_file) AS source_file, min(page) AS page_number, bool_or(is_table_of_contents) AS is_table_of_contents FROM c GROUP BY page_id",
    "containment_edges": f"""WITH {sql.CHUNKS} SELECT 'DOCUMENT_HAS_CHUNK' AS kind, source_file AS from_id, chunk_id AS to_id FROM c UNION ALL SELECT 'PAGE_HAS_CHUNK', page_id, chunk_id FROM c
        UNION ALL SELECT DISTINCT 'DOCUMENT_HAS_PAGE', source_file, page_id FROM c""",
    "bound_document_edges": f"WITH {sql.CHUNKS} SELECT source_file AS document_id, chunk_id FROM c WHERE source_file IN (SELECT document_id FROM source_documents)",
    "next_edges": f"WITH {sql.CHUNKS}, {_NEXT} SELECT chunk_id, next_id FROM nx",
    "upserted_documents": "SELECT document_id, epoch_us(arg_min(created_at, updated_at)) AS created_us, epoch_us(max(updated_at)) AS updated_us FROM source_documents WHERE document_id IS NOT NULL GROUP BY document_id",
    "graph_verification": f"""WITH {sql.CHUNKS}, {sql.TERMS}, {sql.DOCUMENTS}, {_NEXT} SELECT 'documents' AS metric, count(*) AS value FROM d UNION ALL SELECT 'chunks', count(*) FROM c UNION ALL SELECT 'pages', count(DISTINCT page_id) FROM c
        UNION ALL SELECT 'contents_chunks', count(*) FILTER (is_table_of_contents) FROM c UNION ALL SELECT 'section_chunks', count(section_id) FROM c UNION ALL SELECT 'next_edges', count(*) FROM nx UNION ALL SELECT 'concepts', count(DISTINCT concept_id) FROM concepts
        UNION ALL SELECT 'leaf_concepts', count(DISTINCT concept_id) FROM concepts WHERE level = 2 UNION ALL SELECT 'terms', count(*) FROM t UNION ALL SELECT 'normalized_to', count(*) FROM t WHERE concept_id IN (SELECT concept_id FROM concepts)
        UNION ALL SELECT 'taxonomy_edges', count(*) FROM (SELECT DISTINCT parent_concept_id, child_concept_id FROM taxonomy_edges)""",
    "semantic_counts": "SELECT 'Concept' AS label, count(DISTINCT concept_id) AS n FROM concepts UNION ALL SELECT 'Term', count(DISTINCT term_id) FROM terms",
    "induction_chunks": f"WITH {sql.CHUNKS} SELECT chunk_id, sha256(coalesce(retrieval_text, text)) AS body_hash, source_file, page, chunk_index FROM c WHERE text IS NOT NULL AND NOT coalesce(is_table_of_contents, false)",
    "registered_terms": f"WITH {sql.TERMS} SELECT term_id, text AS term_text, match_type, concept_id, k.name AS concept_name FROM t JOIN (SELECT DISTINCT concept_id, name FROM concepts) k USING (concept_id)",
    "latest_runs": f"WITH {sql.TERMS} SELECT run_id FROM t WHERE run_id IS NOT NULL GROUP BY run_id ORDER BY max(updated_at) DESC NULLS LAST, run_id LIMIT 1",
    "evidence_edges": f"WITH {sql.MENTIONED}, {_EDGES_ONLY} SELECT chunk_id, concept_id, max(confidence) AS confidence FROM (SELECT * FROM ce UNION ALL SELECT * FROM cm) GROUP BY ALL",
    "cleared_provenance": f"WITH {sql.CHUNKS}, {_LAYERS} SELECT label, n AS stored, CASE WHEN layer = 'provenance' THEN n ELSE 0 END AS removed FROM ly",
    "cleared_semantics": f"WITH {sql.CHUNKS}, {_LAYERS} SELECT label, n AS stored, CASE WHEN layer = 'semantic' THEN n ELSE 0 END AS removed FROM ly",
    "latest_concepts": f"""WITH {sql.TERMS}, lr AS (SELECT run_id FROM t WHERE text IS NOT NULL AND run_id IS NOT NULL GROUP BY run_id ORDER BY max(updated_at) DESC NULLS LAST, run_id LIMIT 1), top AS (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY ctfidf_score DESC, term_id) AS n FROM t WHERE text IS NOT NULL AND run_id IN (SELECT run_id FROM lr))
        SELECT k.concept_id, name, description, term_fields FROM (SELECT DISTINCT concept_id, name, description FROM concepts WHERE level = 2) k LEFT JOIN (SELECT concept_id, string_agg(text, '|' ORDER BY n) AS term_fields FROM top WHERE n <= 12 GROUP BY concept_id) USING (concept_id)""",
    "leaf_concepts": "SELECT DISTINCT concept_id, name, category FROM concepts WHERE level = 2",
    "two_hops": """WITH RECURSIVE e AS (SELECT DISTINCT parent_concept_id AS a, child_concept_id AS b FROM taxonomy_edges), r AS (SELECT DISTINCT concept_id AS seed, concept_id AS node, 0 AS depth FROM concepts UNION ALL SELECT seed, b, depth + 1 FROM r JOIN e ON node = a WHERE depth < 2)
        SELECT seed, node, min(depth)::INT AS depth FROM r GROUP BY seed, node""",
    "named_concepts": f"WITH {sql.TERMS} SELECT DISTINCT concept_id FROM concepts k WHERE contains(lower(name), '{QUERY_WORD}') OR EXISTS (SELECT 1 FROM t WHERE t.concept_id = k.concept_id AND contains(lower(t.text), '{QUERY_WORD}'))",
    "cooccurrence_facts": f"WITH {_FACTS} SELECT chunk_id, s AS subject_concept_id, o AS object_concept_id, sha256(quote) AS quote_hash, 0.35::DOUBLE AS confidence FROM cand",
    "reviewed_facts": f"WITH {_FACTS} SELECT fact_id, subject_concept_id, predicate, object_concept_id, status FROM f",
    "pending_review": f"""WITH {_FACTS}, r AS (SELECT fact_id, chunk_id, row_number() OVER (PARTITION BY fact_id ORDER BY source_file, page, chunk_id, quote) AS n FROM f JOIN sup USING (fact_id) WHERE status = 'pending')
        SELECT fact_id, 0.35::DOUBLE AS confidence, count(*) AS evidence_count, string_agg(chunk_id, ',' ORDER BY n) FILTER (n <= 3) AS evidence_chunks FROM r GROUP BY fact_id ORDER BY evidence_count DESC, fact_id LIMIT 20""",
    "stored_again": f"WITH {_FACTS} SELECT status, count(*) AS n FROM f GROUP BY status",
    "unsupported_chunks": f"WITH {_FACTS} SELECT chunk_id, string_agg(DISTINCT concept_id, ',' ORDER BY concept_id) AS concept_ids FROM ce WHERE chunk_id NOT IN (SELECT chunk_id FROM sup) GROUP BY chunk_id",
    "approved_facts": f"""WITH {_FACTS}, ids AS (SELECT DISTINCT concept_id FROM concepts WHERE level = 2 ORDER BY concept_id LIMIT 3), k AS (SELECT * FROM f WHERE status = 'approved' AND (subject_concept_id IN (SELECT concept_id FROM ids) OR object_concept_id IN (SELECT concept_id FROM ids)) ORDER BY fact_id LIMIT 8)
        SELECT fact_id, subject_concept_id, object_concept_id, least(3, count(chunk_id))::INT AS n_quotes FROM k LEFT JOIN sup USING (fact_id) GROUP BY ALL""",
    "fact_search": f"""WITH {_FACTS}, n AS (SELECT DISTINCT concept_id, name FROM concepts) SELECT fact_id, chunk_id, a.name AS subject, b.name AS object, '[' || source_file || ' p.' || page || ']' AS citation FROM f JOIN n a ON a.concept_id = subject_concept_id JOIN n b ON b.concept_id = object_concept_id JOIN sup USING (fact_id)
        WHERE status = 'approved' AND (contains(lower(a.name), '{QUERY_WORD}') OR contains(lower(b.name), '{QUERY_WORD}') OR contains(lower(predicate), '{QUERY_WORD}')) ORDER BY fact_id, chunk_id, quote LIMIT 8""",
    "corpus_fingerprint": f"""WITH {sql.CHUNKS}, one AS (SELECT source_file, page, chunk_index, chunk_id, sha256(chunk_id || chr(0) || coalesce(retrieval_text, text, '')) AS h FROM c),
        pg AS (SELECT source_file, page, sha256(string_agg(h, chr(30) ORDER BY chunk_index, chunk_id)) AS h, count(*) AS n FROM one GROUP BY source_file, page),
        pb AS (SELECT source_file, page // 256 AS b, sha256(string_agg(h, chr(30) ORDER BY page)) AS h, sum(n) AS n FROM pg GROUP BY ALL), dc AS (SELECT source_file, sha256(string_agg(h, chr(30) ORDER BY b)) AS h, sum(n) AS n FROM pb GROUP BY source_file),
        db AS (SELECT left(sha256(source_file), 3) AS b, sha256(string_agg(h, chr(30) ORDER BY source_file)) AS h, sum(n) AS n FROM dc GROUP BY ALL) SELECT sum(n)::BIGINT AS chunks, sha256(string_agg(h, chr(30) ORDER BY b)) AS corpus_hash FROM db""",
}

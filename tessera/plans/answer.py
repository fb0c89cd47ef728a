"""The layered policy for one question: exact terms, nearly exact ones, vectors, then keywords."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalize_question
from tessera.functions.vector import similarities
from tessera.operators import facts
from tessera.operators import retrieve as R
from tessera.plans.graph_queries import _facts, evidence_edges
from tessera.plans.runtime import cut_lineage
from tessera.sources import tables


def answer(spark: SparkSession, sf_dir: str, question: str, chunk_limit: int = 8, fact_limit: int = 8, encode=None) -> DataFrame:
    """One row (question, intent, answer): a JSON with how the question was resolved and the cited chunks.

    encode: question -> vector in the space of resolver_embedding; without it the vector step is passed over.
    Each step runs only where the one before gave no concept.
    """
    asked = spark.createDataFrame([("q", question)], "question_id string, question string")
    first = asked.select(R.intent(F.col("question")), normalize_question(F.col("question")), R.keywords(F.col("question"))).first()
    intent, normalized, words = first[0], first[1], list(first[2])
    own = tables.terms(spark, sf_dir)
    named = own.select("term_id", "concept_id", "text", "match_type")
    status, method, found, shown = "resolved", "exact_term", R.grouped(R.exact_matches(asked, named)).orderBy("concept_id").collect(), []
    if not found:
        near = R.fuzzy_decision(R.grouped(R.fuzzy_matches(asked, named))).collect()
        method, found, status = "fuzzy_term", near, near[0]["status"] if near else "unresolved"
    if status != "resolved" and encode is not None:
        leaves = tables.concepts(spark, sf_dir).where("level = 2")
        fields = cut_lineage(R.concept_fields(leaves, own).where("vec IS NOT NULL").withColumn("field_id", F.concat_ws("|", "concept_id", "field", "text")))
        vector = spark.createDataFrame([("q", [float(x) for x in encode(" ".join(words) or question)])], "question_id string, q array<double>")
        scores = similarities(vector, "question_id", "q", fields.select("field_id", "vec"), "field_id", "vec")
        shown = R.semantic_decision(R.max_similarity(scores, fields), single=intent != "comparison").orderBy("rank").collect()
        status, method = shown[0]["status"] if shown else status, "multilingual_term_maxsim"
        found = [r for r in shown if r["taken"]] or found
    concepts = [{"concept_id": r["concept_id"], "confidence": r["confidence"], "terms": list(r["matched_terms"]) if "matched_terms" in r else [r["matched_text"]]} for r in found]
    terms = [t for c in concepts for t in c["terms"]]
    chunks = tables.chunks(spark, sf_dir, "text", "retrieval_text", "source_file", "page", "section_id", "is_table_of_contents")
    edges = evidence_edges(spark, sf_dir)
    over = max(25 * chunk_limit, 100)
    votes = []
    if status == "resolved" and concepts:
        candidates, way = R.concept_chunks(edges, chunks, [c["concept_id"] for c in concepts], over), "concept_graph"
    else:
        candidates, way = cut_lineage(R.lexical_chunks(chunks, words, over)), "lexical_chunk_fallback"
        votes = [r.asDict() for r in R.concept_votes(candidates, edges).collect()]
    known = []
    if way == "concept_graph":
        _, nodes, supports, texts = _facts(spark, sf_dir)
        known = [r.asDict(recursive=True) for r in facts.approved(nodes, supports, texts, [c["concept_id"] for c in concepts], fact_limit).collect()]
    best = R.ranked(candidates, terms or words, intent, chunk_limit).select("chunk_id", "relevance", "citation").collect()
    result = {
        "normalized_question": normalized, "status": status, "method": method, "concepts": concepts, "candidates": [{"concept_id": r["concept_id"], "confidence": r["confidence"]} for r in shown] or votes,
        "retrieval_method": way, "keywords": words, "chunks": [r.asDict() for r in best], "facts": known,
    }
    return spark.createDataFrame([(question, intent, json.dumps(result, ensure_ascii=False, sort_keys=True))], "question string, intent string, answer string")

"""Facts between concepts: extraction by co-occurrence, validation, review, reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import upsert
from tessera.operators.retrieve import with_citation

#: Predicates a fact may have.
PREDICATES = ("REQUIRES", "RESPONSIBLE_FOR", "MITIGATES", "APPLIES_TO", "PROHIBITS", "REPORTS_TO", "MONITORS", "RELATED_TO")
STATUSES = ("pending", "approved", "rejected")
QUOTE, CONFIDENCE = 500, 0.35


def fact_id(subject: Column, predicate: Column, object_: Column) -> Column:
    return F.concat(F.lit("fact_"), F.substring(F.sha2(F.lower(F.concat_ws("|", subject, predicate, object_)), 256), 1, 24))


def unsupported_chunks(chunks: DataFrame, edges: DataFrame, supports: DataFrame, limit: int | None = None) -> DataFrame:
    """(chunk_id, text, concept_ids): chunks with a concept and no fact yet, in document order."""
    held = edges.groupBy("chunk_id").agg(F.array_sort(F.collect_set("concept_id")).alias("concept_ids"))
    out = chunks.join(held, "chunk_id").join(supports.select("chunk_id"), "chunk_id", "left_anti")
    return out.orderBy("source_file", "page", "chunk_index", "chunk_id").limit(limit) if limit else out


def cooccurrences(chunks: DataFrame) -> DataFrame:
    """chunks: chunk_id, text, concept_ids (sorted). A candidate fact for each pair of concepts of a chunk (a chunk has few).

    Blank texts give none; the quote is the beginning of the text.
    """
    quote = F.substring(F.regexp_replace("text", "^\\s+|\\s+$", ""), 1, QUOTE)
    ids = F.col("concept_ids")
    pairs = F.flatten(F.transform(ids, lambda a: F.transform(F.filter(ids, lambda b: b > a), lambda b: F.struct(a.alias("s"), b.alias("o")))))
    rows = chunks.where(F.coalesce("text", F.lit("")).rlike("\\S")).select("chunk_id", quote.alias("evidence_quote"), F.explode(pairs).alias("p"))
    return rows.select("chunk_id", F.col("p.s").alias("subject_concept_id"), F.lit("RELATED_TO").alias("predicate"), F.col("p.o").alias("object_concept_id"), "evidence_quote", F.lit(CONFIDENCE).alias("confidence"))


def valid(candidates: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates between concepts of their chunk, with a known predicate, a quote from the chunk and a confidence in [0, 1]."""
    of = edges.select("chunk_id", "concept_id").distinct()
    held = candidates.join(of.withColumnRenamed("concept_id", "subject_concept_id"), ["chunk_id", "subject_concept_id"], "left_semi").join(of.withColumnRenamed("concept_id", "object_concept_id"), ["chunk_id", "object_concept_id"], "left_semi")
    quoted = held.join(chunks.select("chunk_id", F.col("text").alias("_text")), "chunk_id").where(F.col("_text").contains(F.regexp_replace("evidence_quote", "^\\s+|\\s+$", "")))
    return quoted.where(F.col("predicate").isin(*PREDICATES) & F.col("confidence").between(0, 1)).drop("_text")


def fact_nodes(candidates: DataFrame) -> DataFrame:
    """Facts of accepted candidates, pending."""
    key = fact_id(F.col("subject_concept_id"), F.col("predicate"), F.col("object_concept_id"))
    return candidates.select(key.alias("fact_id"), "subject_concept_id", "predicate", "object_concept_id").distinct().withColumn("status", F.lit("pending"))


def supports(candidates: DataFrame, extractor: str = "rules") -> DataFrame:
    """SUPPORTS edges, one per chunk, fact, extractor and quote."""
    key = fact_id(F.col("subject_concept_id"), F.col("predicate"), F.col("object_concept_id"))
    return candidates.select("chunk_id", key.alias("fact_id"), F.lit(extractor).alias("extractor"), F.col("evidence_quote").alias("quote"), "confidence").groupBy("chunk_id", "fact_id", "extractor", "quote").agg(F.max("confidence").alias("confidence"))


def write_facts(stored: DataFrame, candidates: DataFrame) -> DataFrame:
    """Stored facts with the new ones; the status is set on creation only."""
    return upsert(stored, fact_nodes(candidates), ["fact_id"], once=("status",))


def pending(facts: DataFrame, supports: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Facts to review: best confidence, number of supports, up to three quotes in order of file, page and chunk."""
    rows = facts.where("status = 'pending'").join(supports, "fact_id").join(chunks.select("chunk_id", "source_file", "page"), "chunk_id")
    first = F.slice(F.array_sort(F.collect_set(F.struct("source_file", "page", "chunk_id", "quote"))), 1, 3)
    order = Window.partitionBy("fact_id").orderBy("source_file", "page", "chunk_id", "quote")
    few = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= 3).groupBy("fact_id").agg(first.alias("evidence"))
    sums = rows.groupBy("fact_id", "subject_concept_id", "predicate", "object_concept_id").agg(F.max("confidence").alias("confidence"), F.count("*").alias("evidence_count"))
    return sums.join(few, "fact_id").orderBy(F.desc("confidence"), F.desc("evidence_count"), "fact_id").limit(limit)


def set_status(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: fact_id, new_status. An id that is not stored is an error."""
    unknown = changes.join(facts, "fact_id", "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"no such fact: {unknown[0]['fact_id']}")
    return facts.join(changes.select("fact_id", "new_status"), "fact_id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def approved(facts: DataFrame, supports: DataFrame, chunks: DataFrame, concept_ids: list[str], limit: int) -> DataFrame:
    """Approved facts on any of the concepts with up to three quotes."""
    kept = facts.where((F.col("status") == "approved") & (F.col("subject_concept_id").isin(concept_ids) | F.col("object_concept_id").isin(concept_ids))).orderBy("fact_id").limit(limit)
    rows = kept.join(supports, "fact_id", "left").join(chunks.select("chunk_id", "source_file", "page"), "chunk_id", "left")
    order = Window.partitionBy("fact_id").orderBy(F.desc("confidence"), "source_file", "page", "chunk_id")
    few = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= 3)
    quotes = F.transform(F.array_sort(F.collect_list(F.when(F.col("quote").isNotNull(), F.struct("n", "quote")))), lambda s: s["quote"])
    return few.groupBy("fact_id", "subject_concept_id", "predicate", "object_concept_id").agg(quotes.alias("quotes"))


def search_facts(query: str, facts: DataFrame, concepts: DataFrame, supports: DataFrame, chunks: DataFrame, limit: int = 8) -> DataFrame:
    """Supports of approved facts that a query names by subject, object or predicate, most confident first."""
    q = query.lower()
    name = concepts.select("concept_id", "name")
    rows = facts.where("status = 'approved'").join(name.select(F.col("concept_id").alias("subject_concept_id"), F.col("name").alias("subject")), "subject_concept_id").join(name.select(F.col("concept_id").alias("object_concept_id"), F.col("name").alias("object")), "object_concept_id")
    rows = rows.where(F.lower("subject").contains(q) | F.lower("object").contains(q) | F.lower("predicate").contains(q))
    out = rows.join(supports, "fact_id").join(chunks.select("chunk_id", "source_file", "page"), "chunk_id")
    return with_citation(out.orderBy(F.desc("confidence"), "fact_id", "chunk_id", "quote").limit(limit))

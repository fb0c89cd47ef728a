"""The provenance graph as tables: one DataFrame per node label and edge type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.runtime import read_table
from tessera.sources.store import stored


def latest(df: DataFrame, key: str) -> DataFrame:
    """One row per key, the last loaded; rows without a key are dropped. A node's key is unique hereafter."""
    rest = [c for c in df.columns if c not in (key, "updated_at") and not c.endswith("embedding")]
    order = Window.partitionBy(key).orderBy(F.col("updated_at").desc_nulls_last(), F.xxhash64(key, *rest))
    return df.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Chunk nodes, one row per id, only the named columns read. They are stored at the first use and read from there."""
    table = read_table(spark, sf_dir, "chunks")
    wanted = list(dict.fromkeys(["chunk_id", *(columns or [c for c in table.columns if c != "updated_at"])]))
    return stored(spark, sf_dir, "chunks", lambda: latest(table, "chunk_id").drop("updated_at")).select(*wanted)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(read_table(spark, sf_dir, "source_documents"), "document_id")


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(read_table(spark, sf_dir, "terms"), "term_id")


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "concepts").dropDuplicates(["concept_id"])


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HAS_SUBCONCEPT edges; a repeated edge is one, with its highest confidence."""
    edges = read_table(spark, sf_dir, "taxonomy_edges")
    return edges.groupBy("parent_concept_id", "child_concept_id").agg(F.max("confidence").alias("confidence"))


def pages_of_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as page texts (doc, page, text): each source a document, each of its texts a page, in order of id."""
    rows = read_table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("doc"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    page = F.row_number().over(Window.partitionBy("doc").orderBy("doc_id"))
    # the page numbers are joined to the texts, so the sort by document carries ids only
    numbers = rows.select("doc", "doc_id", page.alias("page"))
    return rows.drop("doc").join(numbers, "doc_id").select("doc", "page", "doc_id", "text")

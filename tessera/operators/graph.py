"""Nodes, edges, upserts and counts of the provenance graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def document_nodes(documents: DataFrame) -> DataFrame:
    return documents.select("document_id", "file_name", "source_stem", "sha256")


def page_nodes(chunks: DataFrame) -> DataFrame:
    """Pages that hold a chunk; a page is a contents page if one of its chunks is."""
    return chunks.groupBy("page_id").agg(F.min("source_file").alias("source_file"), F.min("page").alias("page_number"), F.max("is_table_of_contents").alias("is_table_of_contents"))


def page_edges(chunks: DataFrame) -> DataFrame:
    """HAS_CHUNK of pages (IN_PAGE is its inverse), HAS_CHUNK and HAS_PAGE of documents, in one table."""
    edge = lambda kind, a, b: chunks.select(F.lit(kind).alias("kind"), F.col(a).alias("from_id"), F.col(b).alias("to_id"))
    return edge("DOCUMENT_HAS_CHUNK", "source_file", "chunk_id").unionByName(edge("PAGE_HAS_CHUNK", "page_id", "chunk_id")).unionByName(edge("DOCUMENT_HAS_PAGE", "source_file", "page_id").distinct())


def next_edges(chunks: DataFrame) -> DataFrame:
    """NEXT: from each chunk to the following one of its document.

    In two steps, so that a document with a third of all chunks isn't sorted in one task:
    inside a page by a window, and from the last chunk of a page to the first of the next
    page that has one, on a table of one row per page.
    """
    inside = Window.partitionBy("source_file", "page").orderBy("chunk_index", "chunk_id")
    here = chunks.select("chunk_id", F.lead("chunk_id").over(inside).alias("next_id")).where("next_id IS NOT NULL")
    order = F.struct("chunk_index", "chunk_id")
    pages = chunks.groupBy("source_file", "page").agg(F.min(order)["chunk_id"].alias("first"), F.max(order)["chunk_id"].alias("last"))
    across = pages.select(F.col("last").alias("chunk_id"), F.lead("first").over(Window.partitionBy("source_file").orderBy("page")).alias("next_id")).where("next_id IS NOT NULL")
    return here.unionByName(across)


def bound_edges(edges: DataFrame, sources: DataFrame, source_key: str, targets: DataFrame, target_key: str, source: str | None = None, target: str | None = None) -> DataFrame:
    """Edges both of whose ends exist; the others are dropped, as a matching writer does."""
    a, b = source or source_key, target or target_key
    kept = edges.join(sources.select(F.col(source_key).alias(a)).distinct(), a, "left_semi")
    return kept.join(targets.select(F.col(target_key).alias(b)).distinct(), b, "left_semi").select(*edges.columns)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], once: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both tables by key; where both have one, new values win but for the columns set only on creation."""
    rest = [c for c in stored.columns if c not in keys]
    a = stored.select(*keys, F.struct(*rest).alias("_old"))
    b = new.select(*keys, F.struct(*rest).alias("_new"))
    pick = lambda c: (F.when(F.col("_old").isNotNull(), F.col("_old")[c]).otherwise(F.col("_new")[c]) if c in once else F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col("_old")[c])).alias(c)
    return a.join(b, keys, "full_outer").select(*keys, *map(pick, rest))


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """The table itself; fails when a key is missing or repeated."""
    bad = df.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(1).collect()
    if bad:
        raise ValueError(f"{key} is not a unique key: {bad[0][0]!r}")
    return df


def refuse_existing(counts: DataFrame, allowed: bool) -> None:
    """Stops a load over existing nodes unless it is meant to replace them."""
    found = {r["label"]: r["n"] for r in counts.collect() if r["n"]}
    if found and not allowed:
        raise FileExistsError(f"existing nodes: {found}")


def label_counts(**tables: DataFrame) -> DataFrame:
    """(label, n) of each table."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("label")).groupBy("label").count() for name, df in tables.items()]).withColumnRenamed("count", "n")


def metrics(**numbers: tuple[DataFrame, Column]) -> DataFrame:
    """(metric, value): one aggregate of each table; tables are scanned once each by the union's branches."""
    return reduce(DataFrame.unionByName, [df.agg(c.cast("long").alias("value")).select(F.lit(name).alias("metric"), "value") for name, (df, c) in numbers.items()])


def two_hops(edges: DataFrame, seeds: DataFrame, parent: str = "parent_concept_id", child: str = "child_concept_id", hops: int = 2) -> DataFrame:
    """(seed, node, depth): all nodes within so many steps down from a seed, at their least depth; the seed itself at 0."""
    step = edges.select(F.col(parent).alias("node"), F.col(child).alias("next")).distinct()
    at = seeds.select(F.col(seeds.columns[0]).alias("seed"), F.col(seeds.columns[0]).alias("node"), F.lit(0).alias("depth")).distinct()
    found = at
    for depth in range(1, hops + 1):
        at = at.join(step, "node").select("seed", F.col("next").alias("node"), F.lit(depth).alias("depth")).distinct()
        found = found.unionByName(at)
    return found.groupBy("seed", "node").agg(F.min("depth").alias("depth"))


def fingerprint(chunks: DataFrame) -> DataFrame:
    """(chunks, corpus_hash): sha256 over the digests of all chunks in document order.

    A tree of digests: per chunk, per page, per block of 256 pages, per document, per block of documents (the first three
    digits of their names' hashes), then over at most 4,096 blocks. Only digests are gathered, a node's children at a time.
    """
    one = F.sha2(F.concat_ws("\x00", "chunk_id", F.coalesce("retrieval_text", "text", F.lit(""))), 256)

    def level(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
        joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "d"))), lambda s: s["d"]), "\x1e"), 256)
        return rows.groupBy(*key).agg(joined.alias("d"), F.sum("n").alias("n"))

    rows = chunks.select("source_file", "page", "chunk_index", "chunk_id", one.alias("d"), F.lit(1).cast("long").alias("n"))
    pages = level(rows, ["source_file", "page"], ["chunk_index", "chunk_id"]).withColumn("b", F.floor(F.col("page") / 256))
    docs = level(level(pages, ["source_file", "b"], ["page"]), ["source_file"], ["b"]).withColumn("b", F.left(F.sha2("source_file", 256), F.lit(3)))
    return level(level(docs, ["b"], ["source_file"]), [], ["b"]).select(F.coalesce("n", F.lit(0)).alias("chunks"), F.col("d").alias("corpus_hash"))


def latest_run(rows: DataFrame, run: str, written: str) -> DataFrame:
    """(run_id): the run that was written last; equal times are ordered by id. None where no row has a run."""
    last = rows.where(F.col(run).isNotNull()).groupBy(run).agg(F.max(written).alias("t"))
    return last.orderBy(F.desc_nulls_last("t"), run).limit(1).select(run)


def cleared(layers: dict[str, tuple[str, DataFrame]], layer: str) -> DataFrame:
    """(label, stored, removed): what clearing a layer removes of each table: all of its own, nothing of another's.

    A load over an existing layer first checks refuse_existing, then writes its tables anew (sources.store.clear).
    """
    counts = [df.select(F.lit(name).alias("label")).groupBy("label").count().withColumn("removed", F.col("count") if own == layer else F.lit(0).cast("long")) for name, (own, df) in layers.items()]
    return reduce(DataFrame.unionByName, counts).withColumnRenamed("count", "stored")

"""Files: source documents with their hash, an embedding cache, markdown out."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import SPACE


def source_files(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """(file_name, length, sha256) of the files directly in a folder, ordered by path; the suffix in any case."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path")


def cached_vectors(spark: SparkSession, folder: str, model: str, corpus_hash: str, chunks: DataFrame, encode) -> tuple[DataFrame, bool]:
    """Vectors of the chunks (chunk_id, embedding) and whether they came from the cache.

    The cache is a table keyed by model and corpus hash; it counts only if it holds exactly the chunks asked for.
    """
    path = f"{folder}/model={model.replace('/', '_')}/corpus={corpus_hash[:20]}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        held = spark.read.parquet(path)
        ids = chunks.select("chunk_id")
        other = ids.exceptAll(held.select("chunk_id")).union(held.select("chunk_id").exceptAll(ids))
        if other.isEmpty():
            return held, True
    encode(chunks).select("chunk_id", "embedding").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), False


def safe_component(value: Column, fallback: str = "untitled") -> Column:
    """A readable name that file systems take."""
    plain = F.regexp_replace(F.regexp_replace(value, '[<>:"/\\\\|?*\\x00-\\x1f]', "_"), f"[{SPACE}]+", " ")
    return F.coalesce(F.nullif(F.regexp_replace(plain, "^[ .]+|[ .]+$", ""), F.lit("")), F.lit(fallback))


def chunk_file_name(chunk: DataFrame) -> Column:
    """p0001_c001_section_part-02.md; the part only from the second on."""
    part = F.when(F.col("split_part") > 1, F.format_string("_part-%02d", F.col("split_part").cast("int"))).otherwise("")
    return F.concat(F.format_string("p%04d_c%03d_", "page", "chunk_index"), safe_component(F.coalesce("section_id", F.lit("no-section"))), part, F.lit(".md"))


def yaml_value(value: Column, kind: str) -> Column:
    """JSON strings are YAML strings; null, numbers and booleans as they are."""
    if kind != "string":
        return F.coalesce(value.cast("string"), F.lit("null"))
    return F.coalesce(F.regexp_extract(F.to_json(F.struct(value.alias("v"))), '^\\{"v":(.*)\\}$', 1), F.lit("null"))


#: The keys of the front matter and the columns they show.
FRONT = {k: k for k in ("chunk_id", "source_file", "document_sha256")} | {"pdf_page": "page", "chunk_index": "chunk_index"} | {k: k for k in ("section_id", "section_title", "section_path", "is_table_of_contents", "estimated_tokens")}
FRONT |= {"source_start_line": "start_line", "source_end_line": "end_line", "split_part": "split_part", "chunking_method": "chunking_method"}


def markdown(chunks: DataFrame, link: str = "../../") -> DataFrame:
    """(document, file_name, content) of every chunk: front matter, a link to the page, both texts."""
    kinds = dict(chunks.dtypes)
    front = [F.concat(F.lit(f"{k}: "), F.when(F.col(c).isNull(), "null").otherwise(yaml_value(F.col(c), kinds[c]))) for k, c in FRONT.items()]
    page = F.col("page").cast("string")
    # url_encode is for forms; a path keeps its slashes and writes a blank as %20
    target = F.replace(F.replace(F.url_encode("source_file"), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    content = F.concat(
        F.lit("---\n"), F.array_join(F.array(*front), "\n"), F.lit("\n---\n\n# "), "chunk_id", F.lit("\n\n[Open source PDF at page "), page, F.lit("]("), F.lit(link), target, F.lit("#page="), page,
        F.lit(")\n\n## Retrieval Context\n\n"), F.coalesce("retrieval_text", F.lit("")), F.lit("\n\n## Source Text\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"),
    )
    return chunks.select(safe_component(F.regexp_replace("source_file", "\\.[^.]*$", "")).alias("document"), chunk_file_name(chunks).alias("file_name"), content.alias("content"))


def document_index(chunks: DataFrame) -> DataFrame:
    """Per document: chunks and contents chunks."""
    return chunks.groupBy("source_file").agg(F.count("*").alias("chunks"), F.count_if("is_table_of_contents").alias("contents_chunks"))


def export_markdown(chunks: DataFrame, folder: str, overwrite: bool = False) -> None:
    """One file per chunk in a folder per document, written by the executors to a folder that all of them share; refuses a folder in use."""
    if os.path.isdir(folder) and os.listdir(folder) and not overwrite:
        raise FileExistsError(f"{folder} is not empty")

    written = chunks.sparkSession.sparkContext.accumulator(0)

    def write(rows) -> None:
        for r in rows:
            written.add(1)
            place = os.path.join(folder, r.document)
            os.makedirs(place, exist_ok=True)
            with open(os.path.join(place, r.file_name), "w", encoding="utf-8") as f:
                f.write(r.content)

    markdown(chunks).foreachPartition(write)
    seen = sum(len(names) for _, _, names in os.walk(folder))
    if seen < written.value:  # (a task that ran twice writes the same files again and counts them again)
        raise OSError(f"{written.value} files were written and {seen} are in {folder}; it must be a folder that all executors and the driver share")

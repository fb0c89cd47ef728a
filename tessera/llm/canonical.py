"""Problem 2: one form for texts that look the same.

Every text is mapped to a skeleton (width forms, blanks, hyphens, invisible characters,
ligatures and letters of other alphabets; in the JVM, by one translate). Skeletons are
grouped under the accent- and case-sensitive UNICODE collation in SQL, which also unites
composed and decomposed accents; each class takes its smallest plain member as canonical
form, which is joined back.

Only texts that can have a partner reach the collation: a coarser key (skeleton without
marks) is hashed, and hashes with one stored text are left out first, so two numbers per
row are shuffled, not the texts.

Defined cases: null and blank texts and those of a null scope (concept) belong to no class; equal strings are no pair; line
breaks are not blanks; a text that repeats counts once for each id.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import checks
from tessera.llm.lookalike import characters, expansions, removed, single_map
from tessera.plans.runtime import cut_lineage, read_table

#: Candidate hashes up to this many (16 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_HASHES = 500_000


def _translate(column: Column, table: dict[str, str], dropped: str) -> Column:
    keys = "".join(table)
    return F.translate(column, keys + dropped, "".join(table.values()))


def skeleton(text: Column) -> Column:
    """Look-alikes to one character each; ASCII texts are known by their length and only lose tabs."""
    mapped = _translate(text, single_map(), removed())
    for one, several in expansions().items():
        mapped = F.replace(mapped, F.lit(one), F.lit(several))
    return F.when(F.octet_length(text) == F.char_length(text), F.replace(text, F.lit("\t"), F.lit(" "))).otherwise(mapped)


@functools.cache
def _bases() -> tuple[dict[str, str], str]:
    """Composed letters to their first character; marks, and what decomposes otherwise, dropped."""
    base, dropped = {}, dict.fromkeys(ch for ch in characters() if unicodedata.category(ch) == "Mn")
    for ch in characters():
        if (parts := unicodedata.normalize("NFD", ch)) == ch:
            continue
        if all(p in dropped for p in parts[1:]):
            base[ch] = parts[0]
        else:
            dropped |= dict.fromkeys(ch + parts)
    dropped |= dict.fromkeys(map(chr, range(0x1100, 0x1200)))
    return {a: b for a, b in base.items() if a not in dropped and b not in dropped}, "".join(dropped)


def coarse(skeleton: Column) -> Column:
    """Equal for all skeletons that the collation holds equal."""
    table, dropped = _bases()
    return F.when(F.octet_length(skeleton) == F.char_length(skeleton), skeleton).otherwise(_translate(skeleton, table, dropped))


def same_looking(df: DataFrame) -> DataFrame:
    """df: kind, scope, id, text. The members of all classes with more than one stored text: kind, scope, id, text, canonical."""
    spark = df.sparkSession
    rows = df.select("kind", "scope", "id", "text").where(F.col("text").isNotNull() & F.col("id").isNotNull() & F.col("scope").isNotNull()).withColumn("form", skeleton(F.col("text")))
    rows = rows.where(F.trim(F.translate("form", "\n\r", "  ")) != "")
    rows = rows.withColumn("h", F.xxhash64("kind", "scope", coarse(F.col("form")))).withColumn("t", F.xxhash64("text"))
    several = cut_lineage(rows.groupBy("h").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select("h"))
    hashes = F.broadcast(several) if several.count() <= BROADCAST_HASHES else several
    members = cut_lineage(rows.join(hashes, "h", "left_semi").select("kind", "scope", "id", "text", "form").distinct())
    return spark.sql(
        """
        WITH classes AS (
          SELECT kind, scope, collate(form, 'UNICODE') AS form, min_by(text, struct(text <> form, char_length(text), text)) AS canonical
          FROM {members} GROUP BY kind, scope, collate(form, 'UNICODE') HAVING count(DISTINCT text) > 1)
        SELECT m.kind, m.scope, m.id, m.text, c.canonical
        FROM {members} m JOIN classes c ON m.kind = c.kind AND m.scope = c.scope AND collate(m.form, 'UNICODE') = c.form
        """,
        members=members,
    )


def pairs_of(members: DataFrame) -> DataFrame:
    """Pairs of ids whose texts look the same and differ: every id with the first id of each other text of its class.

    Copies of one text are not paired with all copies of another, so a class of n ids and m texts gives n * m pairs.
    """
    # the class key is kept as a hash of the canonical text and the text of a member as its own hash
    small = cut_lineage(members.select("kind", "scope", "id", F.xxhash64("kind", "scope", "canonical").alias("class"), F.xxhash64("text").alias("t")))
    first = small.groupBy("class", "t").agg(F.min("id").alias("other"), F.first("kind").alias("k"))
    paired = small.join(first.withColumnRenamed("t", "u"), "class").where("t <> u AND id <> other")
    return paired.select(F.least("id", "other").alias("left_id"), F.greatest("id", "other").alias("right_id")).distinct()


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_table(spark, sf_dir, "chunks").select(F.lit("chunk").alias("kind"), F.lit("").alias("scope"), F.col("chunk_id").alias("id"), "text")
    terms = read_table(spark, sf_dir, "terms").select(F.lit("term").alias("kind"), F.col("concept_id").alias("scope"), F.col("term_id").alias("id"), "text")
    return chunks.unionByName(terms)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(same_looking(texts(spark, sf_dir)))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each id of a class with its stored and its consistent text."""
    return same_looking(texts(spark, sf_dir)).select("kind", "id", F.col("text").alias("stored"), "canonical").distinct()


def _sql(select: str) -> str:
    """The same rule in one SQL statement over all rows: composition by nfc_normalize instead of a collation, tables of its own."""
    return f"""
        WITH rows AS (SELECT DISTINCT 'chunk' AS kind, '' AS scope, chunk_id AS id, text FROM chunks WHERE text IS NOT NULL
                      UNION SELECT DISTINCT 'term', concept_id, term_id, text FROM terms WHERE text IS NOT NULL),
        mapped AS (SELECT *, {checks.same('text')} AS plain FROM rows), forms AS (SELECT *, nfc_normalize(plain) AS form FROM mapped)
        {select}"""


QUERIES = {"p2_found": p2_found, "p2_forms": p2_forms}
ORACLE = {
    "p2_found": _sql("""SELECT DISTINCT least(a.id, b.id) AS left_id, greatest(a.id, b.id) AS right_id FROM forms a JOIN forms b
        ON a.kind = b.kind AND a.scope = b.scope AND a.form = b.form AND a.text <> b.text AND a.id <> b.id WHERE trim(translate(a.form, chr(10) || chr(13), '  ')) <> ''"""),
    "p2_forms": _sql("""SELECT kind, id, text AS stored, arg_min(text, (text <> plain, length(text), text)) OVER w AS canonical FROM forms WHERE trim(translate(form, chr(10) || chr(13), '  ')) <> '' AND id IS NOT NULL AND scope IS NOT NULL
        WINDOW w AS (PARTITION BY kind, scope, form) QUALIFY min(text) OVER w <> max(text) OVER w"""),
}

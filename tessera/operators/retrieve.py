"""Questions: resolution to concepts, retrieval, ranking, votes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import CJK, casefold, normalize_question, squeeze
from tessera.operators.fuzzy import Goals
from tessera.operators.matching import occurrences
from tessera.plans.runtime import cut_lineage

#: What words tell the intent of a question, in the order they are tried.
INTENTS = {
    "control_requirements": ("control", "controls", "requirement", "requirements", "required", "must", "should", "控制", "措施", "要求", "規定", "必須", "應當", "須要"),
    "comparison": ("compare", "comparison", "difference", "versus", " vs ", "比較", "分別", "差異", "區別"),
    "definition": ("what is", "define", "definition", "meaning", "甚麼是", "什麼是", "定義", "意思"),
    "procedure": ("how to", "process", "procedure", "steps", "如何", "程序", "流程", "步驟"),
}
#: Words of a question that are no keywords.
LATIN_STOPWORDS = ("a", "an", "and", "are", "control", "controls", "for", "how", "is", "must", "of", "required", "requirement", "requirements", "should", "the", "to", "what", "which")
CHINESE_STOP = ("有哪些", "如何", "甚麼", "什麼", "控制", "措施", "要求", "規定")
#: What raises a chunk for a question about requirements.
CONTROL_WORDS = ("control", "requirement", "required", "must", "should", "控制", "措施", "要求", "規定", "必須")
LIST_PATTERNS = ("include the following", "includes the following", "requirements are", "should include", "以下為", "包括以下", "應包括", "應採取以下", "措施如下")
OVERVIEW_PATTERNS = ("general requirements", "overall requirements", "overview", "何謂", "一般規定", "基本規定")
FUZZY_LEAST, FUZZY_GAP, SEMANTIC_LEAST, SEMANTIC_GAP, TERM_PENALTY = 0.88, 0.05, 0.50, 0.06, 0.03


def intent(question: Column) -> Column:
    """The first intent one of whose words occurs, as a part, in the normalised question.

    The words are normalised as the question is, which takes the blanks from " vs ": a word that holds "vs" counts too.
    """
    text = F.concat(F.lit(" "), normalize_question(question), F.lit(" "))
    out = None
    for name, words in INTENTS.items():
        hit = reduce(lambda a, b: a | b, (text.contains(w.strip()) for w in words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general_information")


def keywords(question: Column) -> Column:
    """Words of a question without stop words, and the pairs of signs of long Chinese ones; each once, in order."""
    words = F.filter(F.split(normalize_question(question), " "), lambda w: (w != "") & ~w.isin(*LATIN_STOPWORDS))

    def cut(word: Column) -> Column:
        for phrase in sorted(CHINESE_STOP, key=len, reverse=True):
            word = F.replace(word, F.lit(phrase), F.lit(" "))
        return F.filter(F.split(word, " "), lambda w: F.length(w) >= 2)

    def pairs(word: Column) -> Column:
        two = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: F.substring(word, i, F.lit(2)))
        return F.when(word.rlike(f"^[{CJK}]{{4,}}$"), F.concat(F.array(word), two)).otherwise(F.array(word))

    return F.array_distinct(F.flatten(F.transform(F.flatten(F.transform(words, cut)), pairs)))


def exact_matches(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """questions: question_id, question. terms: term_id, concept_id, text, match_type. Terms that occur in a question.

    The questions are scanned once for all terms; only what is found is joined with the rest of a term.
    """
    asked = questions.select(F.col("question_id").alias("id"), normalize_question(F.col("question")).alias("body")).withColumn("source", F.lit(None).cast("string"))
    named = terms.select("term_id", "concept_id", F.col("text").alias("term_text"), "match_type", normalize_question(F.col("text")).alias("t")).where("t <> ''")
    found = occurrences(asked, named.select("term_id", F.col("t").alias("body"), (F.col("match_type") == "word").alias("word")).distinct(), folded=True)
    confidence = F.when(F.col("match_type") == "word", 0.98).otherwise(1.0)
    held = found.select(F.col("id").alias("question_id"), "term_id").join(named, "term_id")
    return held.select("question_id", "concept_id", "term_id", "term_text", F.length("t").alias("length"), confidence.alias("confidence"), F.lit("exact_term").alias("method"))


_LATIN = re.compile("[a-z0-9]+")


def _windows(question: str, term: str) -> tuple[list[str], str]:
    """Parts of the question as long as the term, in Latin words if both have any and in signs else, and the term in the same form."""
    asked, goal, glue = _LATIN.findall(question), _LATIN.findall(term), " "
    if not (asked and goal):
        asked, goal, glue = question.replace(" ", ""), term.replace(" ", ""), ""
        if len(goal) < 4:
            return [], ""
    last = max(len(asked) - len(goal), 0)
    return [glue.join(asked[i : i + len(goal)]) for i in range(last + 1)], glue.join(goal)


def fuzzy_similarity(question: str, term: str, least: float = 0.0) -> float:
    """Best ratio of matching blocks of a term with the windows of a question; 0 where none can reach the least ratio.

    A window whose shared signs, in whatever order, are too few is not compared.
    """
    windows, goal = _windows(question, term)
    matcher, best = SequenceMatcher(None, "", goal), 0.0
    counts = Counter(goal)
    for window in dict.fromkeys(windows):
        floor = max(best, least)
        total = len(window) + len(goal)
        if total and 2.0 * min(len(window), len(goal)) < floor * total - 1e-9:
            continue
        if total and 2.0 * (counts & Counter(window)).total() < floor * total - 1e-9:
            continue
        matcher.set_seq1(window)
        best = max(best, matcher.ratio())
    return best if best >= least else 0.0


#: Different texts of terms that are searched for in one pass over the questions.
BLOCK_TERMS = 100_000


def fuzzy_matches(questions: DataFrame, terms: DataFrame, least: float = FUZZY_LEAST) -> DataFrame:
    """Terms nearly in a question.

    Each different text of a question is compared with each different form of a term that can be near it (operators.fuzzy),
    in blocks of terms of bounded size; only what is near is joined with terms and questions.
    """
    asked = questions.select("question_id", normalize_question(F.col("question")).alias("q"))
    named = terms.select("term_id", "concept_id", F.col("text").alias("term_text"), normalize_question(F.col("text")).alias("t"))
    named = cut_lineage(named.where(F.length(F.replace("t", F.lit(" "), F.lit(""))) >= 4))
    asked = cut_lineage(asked.where("q <> ''"))
    wide = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), asked.sparkSession.sparkContext.defaultParallelism)
    texts = cut_lineage(asked.select("q").distinct().repartition(wide, "q"))  # few bytes, but much work each
    goals = named.select("t").distinct()
    blocks = max(1, -(-goals.count() // BLOCK_TERMS))
    near = None
    for block in range(blocks):
        part = goals.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block)
        found = _near(texts, [r[0] for r in part.collect()], least)
        near = found if near is None else near.unionByName(found)
    # a term counts by its Latin words in a question that has some, else by its signs
    words = F.trim(F.regexp_replace("t", "[^a-z0-9]+", " "))
    forms = named.withColumn("key", F.explode(F.array(F.concat(F.lit("l"), words), F.concat(F.lit("s"), F.replace("t", F.lit(" "), F.lit("")))))).where("key <> 'l'")
    # different blocks may hold terms of one form
    scored = near.groupBy("q", "key").agg(F.max("similarity").alias("similarity")).join(forms, "key").join(asked, "q")
    return scored.select("question_id", "concept_id", "term_id", "term_text", F.length("t").alias("length"), F.round("similarity", 4).alias("confidence"), F.lit("fuzzy_term").alias("method"))


def _near(texts: DataFrame, goals: list[str], least: float) -> DataFrame:
    """(q, key, similarity) of the forms of the goals near to each text."""
    sent = texts.sparkSession.sparkContext.broadcast(goals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = None
        for batch in batches:
            asked = batch.column(0).to_pylist()
            searched = searched or Goals(sent.value, least)
            found = searched.search(asked)
            yield pa.RecordBatch.from_arrays([pa.array([asked[i] for i, _, _ in found], pa.string()), pa.array([k for _, k, _ in found], pa.string()), pa.array([x for _, _, x in found], pa.float64())], names=["q", "key", "similarity"])

    return cut_lineage(texts.mapInArrow(run, "q string, key string, similarity double"))


def grouped(matches: DataFrame) -> DataFrame:
    """Per question and concept: best match, confidence raised by 0.02 for each further match, terms in order."""
    order = F.struct(-F.col("confidence"), -F.col("length"), F.col("term_id"), F.col("term_text"))
    one = matches.groupBy("question_id", "concept_id").agg(F.max("confidence").alias("best"), F.count("*").alias("n"), F.first("method").alias("method"), F.array_sort(F.collect_set(order)).alias("terms"))
    confidence = F.round(F.least(F.lit(1.0), F.col("best") + (F.col("n") - 1) * 0.02), 4)
    return one.select("question_id", "concept_id", "method", confidence.alias("confidence"), F.transform("terms", lambda s: s["term_text"]).alias("matched_terms"))


def fuzzy_decision(concepts: DataFrame, gap: float = FUZZY_GAP) -> DataFrame:
    """(question_id, status, concept_id...): the best concept, or all as ambiguous where the second is close."""
    w = Window.partitionBy("question_id").orderBy(F.desc("confidence"), "concept_id")
    ranked = concepts.withColumn("rank", F.row_number().over(w))
    lead = F.first("confidence").over(w) - F.nth_value("confidence", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = ranked.withColumn("status", F.when(F.round(lead, 6) < gap, "ambiguous").otherwise("resolved"))
    return ranked.where((F.col("status") == "ambiguous") | (F.col("rank") == 1)).drop("rank")


def concept_fields(concepts: DataFrame, terms: DataFrame, most: int = 12) -> DataFrame:
    """(concept_id, field, text, vec): the name and the best terms of a concept; equal texts once, the name first."""
    order = Window.partitionBy("concept_id").orderBy(F.desc("ctfidf_score"), "term_id")
    top = terms.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    rows = concepts.select("concept_id", F.lit("concept_name").alias("field"), F.col("name").alias("text"), F.col("resolver_embedding").alias("vec"), F.lit(0).alias("n")).unionByName(
        top.join(concepts.select("concept_id"), "concept_id", "left_semi").select("concept_id", F.lit("term").alias("field"), "text", F.col("resolver_embedding").alias("vec"), "n")
    )
    rows = rows.withColumn("k", squeeze(casefold(F.coalesce("text", F.lit(""))))).where("k <> ''")
    first = Window.partitionBy("concept_id", "k").orderBy("n")
    return rows.withColumn("m", F.row_number().over(first)).where("m = 1").select("concept_id", "field", "text", "vec")


def max_similarity(scores: DataFrame, fields: DataFrame, limit: int = 5) -> DataFrame:
    """scores: question_id, field_id, similarity. Per question the best concepts by their best field, terms 0.03 lower."""
    s = F.col("similarity") - F.when(F.col("field") == "term", TERM_PENALTY).otherwise(0.0)
    rows = scores.join(fields.select("field_id", "concept_id", "field", "text"), "field_id").withColumn("s", F.round(s, 6))
    best = rows.groupBy("question_id", "concept_id").agg(F.max(F.struct("s", "text")).alias("b")).select("question_id", "concept_id", F.col("b.s").alias("confidence"), F.col("b.text").alias("matched_text"))
    w = Window.partitionBy("question_id").orderBy(F.desc("confidence"), "concept_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def semantic_decision(candidates: DataFrame, single: bool = True) -> DataFrame:
    """Adds status, and which candidates are taken: one clearly ahead, or in a comparison up to two close to the best."""
    w = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best, second = F.first("confidence").over(w), F.nth_value("confidence", 2).over(w)
    gap = F.round(best - second, 6)
    status = F.when(best < SEMANTIC_LEAST, "unresolved").when(F.lit(single) & (gap < SEMANTIC_GAP), "ambiguous").otherwise("resolved")
    out = candidates.withColumn("status", status)
    most = 1 if single else 2
    taken = (F.col("status") == "resolved") & (F.col("rank") <= most) & (F.col("confidence") >= SEMANTIC_LEAST) & (F.round(best - F.col("confidence"), 6) <= SEMANTIC_GAP)
    return out.withColumn("taken", taken)


def concept_chunks(edges: DataFrame, chunks: DataFrame, concept_ids: list[str], limit: int) -> DataFrame:
    """Chunks on any of the concepts by either edge, best confidence first."""
    score = edges.where(F.col("concept_id").isin(concept_ids)).groupBy("chunk_id").agg(F.max("confidence").alias("concept_score"))
    return chunks.join(score, "chunk_id").orderBy(F.desc("concept_score"), "source_file", "page", "chunk_id").limit(limit)


def lexical_score(text: Column, words: list[str]) -> Column:
    """How many of the keywords occur."""
    low = F.lower(text)
    return sum((low.contains(w.lower()).cast("int") for w in words), F.lit(0))


def lexical_chunks(chunks: DataFrame, words: list[str], limit: int) -> DataFrame:
    """Chunks outside contents pages that hold a keyword, most keywords first."""
    scored = chunks.where(~F.coalesce("is_table_of_contents", F.lit(False))).withColumn("lexical_score", F.coalesce(lexical_score(F.coalesce("retrieval_text", "text"), words), F.lit(0)))
    return scored.where("lexical_score > 0").orderBy(F.desc("lexical_score"), "source_file", "page", "chunk_id").limit(limit)


def relevance(text: Column, words: list[str], kind: str, lexical: Column | None = None, concept: Column | None = None) -> Column:
    """Integer rank of a chunk for a question: keyword and concept scores, terms named, signs of a list of requirements."""
    t = normalize_question(text)
    score = F.coalesce(lexical if lexical is not None else F.lit(0), F.lit(0)) * 60 + F.bround(F.coalesce(concept if concept is not None else F.lit(0.0), F.lit(0.0)) * 100).cast("int")
    for w in words:
        score = score + F.when(t.contains(normalize_question(F.lit(w))), 100).otherwise(0)
    if kind == "control_requirements":
        for w in CONTROL_WORDS:
            score = score + F.least(F.lit(3), F.regexp_count(t, F.lit(w))) * 10
        for p in LIST_PATTERNS:
            score = score + F.when(F.substring(t, 1, 500).contains(p), 150).otherwise(0)
        for p in OVERVIEW_PATTERNS:
            score = score + F.when(F.substring(t, 1, 300).contains(p), 120).otherwise(0)
    return score - F.when(F.substring(t, 1, 200).contains("目錄"), 1000).otherwise(0)


def ranked(candidates: DataFrame, words: list[str], kind: str, limit: int) -> DataFrame:
    """The best chunks with their relevance and citation."""
    has = lambda c: F.col(c) if c in candidates.columns else None
    score = relevance(F.coalesce("retrieval_text", "text", F.lit("")), words, kind, has("lexical_score"), has("concept_score"))
    return with_citation(candidates.withColumn("relevance", score).orderBy(F.desc("relevance"), "source_file", "page", "chunk_id").limit(limit))


def with_citation(rows: DataFrame) -> DataFrame:
    return rows.withColumn("citation", F.format_string("[%s p.%s]", F.coalesce("source_file", F.lit("unknown source")), F.coalesce(F.col("page").cast("string"), F.lit("?"))))


def concept_votes(candidates: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """Concepts of the candidate chunks by weighted votes; the share is of all votes."""
    votes = candidates.select("chunk_id", F.greatest(F.coalesce("lexical_score", F.lit(1)), F.lit(1)).alias("w")).join(edges.select("chunk_id", "concept_id").distinct(), "chunk_id")
    sums = votes.groupBy("concept_id").agg(F.sum("w").alias("vote"))
    total = sums.agg(F.sum("vote").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select("concept_id", "vote", F.round(F.col("vote") / F.col("total"), 4).alias("confidence")).orderBy(F.desc("vote"), "concept_id").limit(limit)


def search_graph(query: str, concepts: DataFrame, terms: DataFrame, reach: DataFrame, edges: DataFrame, chunks: DataFrame, limit: int = 8) -> DataFrame:
    """Chunks on concepts that a query names (by name, id or term) or on concepts below these, most concepts first.

    reach: (seed, node) of the taxonomy within two steps.
    """
    q = query.lower()
    named = terms.where(F.lower("text").contains(q)).select("concept_id").distinct()
    seeds = concepts.where(F.lower("name").contains(q) | F.col("concept_id").contains(q)).select("concept_id").unionByName(named).distinct()
    seeds = seeds.join(concepts, "concept_id", "left_semi")
    nodes = reach.join(seeds.withColumnRenamed("concept_id", "seed"), "seed", "left_semi").select(F.col("node").alias("concept_id")).unionByName(seeds).distinct()
    names = nodes.join(concepts.select("concept_id", "name"), "concept_id")
    hits = edges.select("chunk_id", "concept_id").distinct().join(names, "concept_id").groupBy("chunk_id").agg(F.array_sort(F.collect_set("name")).alias("concepts"))
    found = hits.join(chunks, "chunk_id").orderBy(F.desc(F.size("concepts")), "source_file", "page", "chunk_index", "chunk_id").limit(limit)
    return with_citation(found)


#: Folders of a stored text index.
INDEX_FOLDERS = 64


def index_folder(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(INDEX_FOLDERS)).cast("int")


def postings(chunks: DataFrame) -> DataFrame:
    """(word, chunk_id, n, length): an inverted index over words and pairs of ideographs. A chunk's words are counted in its own task."""
    text = F.lower(F.coalesce("retrieval_text", "text", F.lit("")))
    words = F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), 1)
    pairs = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"([{CJK}]{{2,}})"), 1), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    held = chunks.select("chunk_id", F.array_sort(F.concat(words, pairs)).alias("words")).where(F.size("words") > 0).withColumn("length", F.size("words"))
    # in a sorted array a word's count is the distance of the places where it begins and the next one does
    starts = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: (i == 1) | (F.element_at("words", i) != F.element_at("words", F.greatest(i - 1, F.lit(1)))))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("words") + 1))
    counted = held.withColumn("starts", starts).withColumn("ends", ends)
    counted = counted.select("chunk_id", "length", F.explode(F.transform("starts", lambda s, k: F.struct(F.element_at("words", s).alias("word"), (F.get("ends", k) - s).cast("long").alias("n")))).alias("p"))
    return counted.select("p.word", "chunk_id", "length", "p.n")


def full_text(index: DataFrame, words: list[str], total: Column | int, mean: float, limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(chunk_id, score): the chunks that match best by BM25."""
    hits = index.where(F.col("word").isin(words))
    frequency = hits.groupBy("word").agg(F.count("*").alias("df"))
    n = F.lit(float(total))
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("length") / F.lit(mean)))
    return hits.join(F.broadcast(frequency), "word").groupBy("chunk_id").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(limit)

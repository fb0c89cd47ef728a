"""Term mining: candidates, cluster scores, diverse selection, mentions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessera.functions.text import CJK, SPACE, detect_language, match_type, normalize_term
from tessera.operators.matching import fold, occurrences
from tessera.plans.runtime import cut_lineage, cut_packed

#: Words that end a run of candidate words.
ENGLISH_STOPWORDS = (
    "a", "about", "above", "after", "again", "against", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "below", "between",
    "both", "but", "by", "can", "could", "do", "does", "doing", "during", "each", "for", "from", "further", "had", "has", "have", "having", "he", "her", "here", "hers", "him",
    "his", "how", "if", "in", "into", "is", "it", "its", "may", "more", "most", "must", "no", "nor", "not", "of", "on", "once", "only", "or", "other", "our", "out", "over", "same",
    "shall", "should", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "through", "to", "under", "until", "up",
    "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "will", "with", "would", "you", "your",
)
CHINESE_STOPWORDS = (
    "之", "了", "其", "及", "於", "與", "和", "一個", "一些", "一般", "不得", "以及", "任何", "但", "例如", "依據", "倘若", "其他", "其中", "則", "包括", "可以", "可能", "各", "同時", "因此", "如", "如果", "就", "應", "應當",
    "應該", "或", "所有", "所述", "按照", "根據", "此外", "然而", "為", "由", "的", "等", "而", "該", "該等", "這些", "這個", "進行", "須",
)
#: Terms that name nothing.
GENERIC_TERMS = (
    "applicable requirements", "authorized institution", "general requirements", "introduction", "overview", "purpose", "relevant requirements", "the authority", "the institution",
    "引言", "目的", "概覽", "範圍", "上述規定", "下列各項", "以下各項", "有關規定", "本章", "本節", "本部分", "本段", "本指引", "該機構", "該認可機構",
)
#: Where English segments end, what an English word is, what numbers a heading.
SEGMENT_ENDS = "[\\n。！？!?；;：:]"
ENGLISH_WORD = "[A-Za-z][A-Za-z0-9]*(?:[-'][A-Za-z0-9]+)*"
HEADING_NUMBER = f"(?i)^(?:第[{SPACE}]*[一二三四五六七八九十百0-9]+[{SPACE}]*章[{SPACE}]*[-—–:：]*[{SPACE}]*|chapter[{SPACE}]+[0-9]+[{SPACE}]*[-—–:：]*[{SPACE}]*|[0-9]+(?:\\.[0-9]+){{0,6}}\\.?[{SPACE}]*)"
ENGLISH_SIZES, CHINESE_SIZES = 4, 3
_ENGLISH_STOP, _CHINESE_STOP = frozenset(ENGLISH_STOPWORDS), frozenset(CHINESE_STOPWORDS)
SIMILAR, TERMS, MENTION_SHARE = 0.88, 12, 0.45


def valid_candidate(term: Column) -> Column:
    """Whether a normalised term may be counted."""
    language = detect_language(term)
    words = F.split(term, " ")
    one_short = (F.size(words) == 1) & (F.length(term) < 3)
    only_stop = F.forall(words, lambda w: w.isin(*ENGLISH_STOPWORDS))
    bad = (F.length(F.replace(term, F.lit(" "), F.lit(""))) < 2) | (F.length(term) > 80) | term.rlike("^[0-9.\\-]+$") | term.isin(*GENERIC_TERMS)
    return (term != "") & ~bad & ~((language == "en") & (one_short | only_stop)) & ~((language == "zh") & term.isin(*CHINESE_STOPWORDS))


def display_form(original: Column, normalized: Column) -> Column:
    """Acronyms stay as they are written."""
    plain = F.regexp_replace(F.trim(original), "^[ .,:;()\\[\\]{}—–-]+|[ .,:;()\\[\\]{}—–-]+$", "")
    return F.when(plain.rlike("^[A-Z][A-Z0-9-]{1,10}$"), plain).otherwise(normalized)


def _runs(parts: Column, stop: Callable[[Column], Column], sizes: int, glue: str) -> Column:
    """All n-grams of the words between stop words, as one array of a row, so nothing is shuffled.

    parts: array of word arrays, one per segment; stop: a boolean of a word. A stop word is a blank that splits the joined words.
    """
    none = F.array().cast("array<string>")
    of_run = lambda run: F.when(run == "", none).otherwise(_grams(F.split(run, "\x01"), sizes, glue))
    joined = lambda words: F.array_join(F.transform(words, lambda w: F.when(stop(w), F.lit("\x02")).otherwise(w)), "\x01")
    return F.flatten(F.transform(F.filter(parts, lambda words: F.size(words) > 0), lambda words: F.flatten(F.transform(F.split(joined(words), "\x01?\x02\x01?"), of_run))))


def _grams(words: Column, sizes: int, glue: str) -> Column:
    def of_size(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.when(F.size(words) >= k, F.array_join(F.slice(words, i, F.lit(k)), glue)))

    return F.array_compact(F.flatten(F.array(*map(of_size, range(1, sizes + 1)))))


def _parts(text: str, segmenter=None) -> tuple[Column, Column]:
    """Words of the English segments and of the runs of ideographs of a text."""
    value = F.coalesce(F.col(text), F.lit(""))
    segments = F.transform(F.split(value, SEGMENT_ENDS), lambda s: F.regexp_extract_all(s, F.lit(f"({ENGLISH_WORD})"), 1))
    runs = F.regexp_extract_all(value, F.lit(f"([{CJK}]{{2,}})"), 1)
    if segmenter is None:  # pairs, in the JVM
        return segments, F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r), F.lit(2)), lambda i: F.substring(r, i, F.lit(2))))
    cut = F.pandas_udf(lambda s: s.map(lambda rs: [list(w) for w in segmenter(pd.Series(list(rs)))]), ArrayType(ArrayType(StringType())))
    return segments, cut(runs)


def _english(parts: Column) -> Column:
    return _runs(parts, lambda w: F.lower(w).isin(*ENGLISH_STOPWORDS), ENGLISH_SIZES, " ")


def _chinese(parts: Column) -> Column:
    return _runs(parts, lambda w: w.isin(*CHINESE_STOPWORDS), CHINESE_SIZES, "")


def _candidate_grams(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, _grams): the n-grams of each row as they are spelt, English and Chinese, in one array."""
    segments, words = _parts(text)
    return texts.select(*key, segments.alias("_s"), words.alias("_w")).select(*key, F.concat(_english(F.col("_s")), _chinese(F.col("_w"))).alias("_grams"))


def _spelt(texts: DataFrame, key: list[str], text: str, segmenter=None) -> DataFrame:
    """(key, original): one row for each n-gram; segments are taken one by one, which keeps their arrays small."""
    segments, words = _parts(text, segmenter)
    one = lambda parts, grams: texts.select(*key, F.explode(parts).alias("_p")).where(F.size("_p") > 0).select(*key, F.explode(grams(F.array("_p"))).alias("original"))
    return one(segments, _english).unionByName(one(words, _chinese))


def _named(counted: DataFrame) -> DataFrame:
    """Adds term and display to counted spellings (original), valid ones only. They hold words and ideographs only, so normalising is lower case."""
    named = counted.withColumn("term", F.lower("original")).where(valid_candidate(F.col("term")))
    return named.withColumn("display", display_form(F.col("original"), F.col("term")))


def candidates(texts: DataFrame, key: list[str], text: str, segmenter=None) -> DataFrame:
    """(key, term, display, n): counted term candidates of each text, English and Chinese.

    segmenter: cuts a pandas Series of ideograph runs into lists of words; without it runs are cut into pairs in the JVM.
    """
    # equal spellings are counted before they are normalised
    counted = _spelt(texts, key, text, segmenter).groupBy(*key, "original").agg(F.count("*").alias("n"))
    return _named(counted).select(*key, "term", "display", "n")


def candidate_table(texts: DataFrame, group: str, text: str) -> DataFrame:
    """texts: one row per chunk. (group, term, display, n, chunks): spellings summed by group, and in how many chunks a term is (on one of its spellings).

    Both are summed in each task before the exchange, so no candidate of a single text is shuffled or written.
    """
    grams = _candidate_grams(texts, [group], text)
    counted = cut_lineage(_named(_spelt(texts, [group], text).groupBy(group, "original").agg(F.count("*").alias("n"))).groupBy(group, "term", "display").agg(F.sum("n").alias("n")))
    once = F.array_distinct(F.transform(F.array_distinct("_grams"), F.lower))
    held = grams.select(group, F.explode(once).alias("term")).groupBy(group, "term").agg(F.count("*").alias("chunks"))
    first = F.row_number().over(Window.partitionBy(group, "term").orderBy("display"))
    out = counted.withColumn("k", first).join(held, [group, "term"])
    return out.select(group, "term", "display", "n", F.when(F.col("k") == 1, F.col("chunks")).otherwise(0).alias("chunks"))


def _headings() -> Column:
    """The headings of a chunk without their numbers, as an array."""
    parts = F.transform(F.split("section_path", ">"), lambda s: F.trim(s))
    headings = F.array_distinct(F.filter(F.concat(F.array("section_title"), F.coalesce(parts, F.array().cast("array<string>"))), lambda s: s.isNotNull()))
    plain = lambda s: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(s, f"[{SPACE}]+", " ")), HEADING_NUMBER, ""), "^[ —–:：-]+|[ —–:：-]+$", "")
    return F.filter(F.transform(headings, plain), lambda s: s != "")


def heading_candidates(chunks: DataFrame, key: list[str]) -> DataFrame:
    """(key, term, display, n): the headings of a chunk, whole with weight 8 and their n-grams with weight 4."""
    each = chunks.select(*key, F.explode(_headings()).alias("heading"))
    whole = each.withColumn("term", normalize_term(F.col("heading"))).where(valid_candidate(F.col("term"))).select(*key, "term", display_form(F.col("heading"), F.col("term")).alias("display"), F.lit(8).cast("long").alias("n"))
    each = each.withColumn("_i", F.monotonically_increasing_id())  # equal headings of one chunk count apart
    grams = candidates(each, [*key, "_i"], "heading").select(*key, "term", "display", (F.col("n") * 4).alias("n"))
    return whole.unionByName(grams)


#: Terms of groups a task holds before it hands their counts on.
HELD_TERMS = 300_000
_SEGMENT_ENDS, _ENGLISH_WORD, _IDEOGRAPHS = re.compile(SEGMENT_ENDS), re.compile(ENGLISH_WORD, re.ASCII), re.compile(f"[{CJK}]{{2,}}")
_ACRONYM, _EDGES = re.compile("[A-Z][A-Z0-9-]{1,10}"), " .,:;()[]{}—–-"
_NO_TERM, _IDEOGRAPH, _LETTER = re.compile(f"[^a-z0-9{CJK}'\\- ]+"), re.compile(f"[{CJK}]"), re.compile("[a-z0-9]")
_COUNTS = "term string, frequency long, chunk_frequency long, heading_frequency long, shouted long"


def grams(text: str) -> tuple[list[str], list[str]]:
    """The n-grams of a text in lower case, as _spelt finds them, and those of its words that are acronyms."""
    out: list[str] = []
    shouted: list[str] = []

    def take(words: list[str], sizes: int, glue: str) -> None:
        out.extend(words)
        for k in range(2, min(sizes, len(words)) + 1):
            out.extend(map(glue.join, zip(*(words[i:] for i in range(k)), strict=False)))

    for segment in _SEGMENT_ENDS.split(text):
        run: list[str] = []
        for word in _ENGLISH_WORD.findall(segment):
            low = word.lower()
            if low in _ENGLISH_STOP:
                take(run, ENGLISH_SIZES, " ")
                run = []
            else:
                run.append(low)
                if _ACRONYM.fullmatch(word):
                    shouted.append(low)
        take(run, ENGLISH_SIZES, " ")
    for signs in _IDEOGRAPHS.findall(text):
        run = []
        for word in (signs[i : i + 2] for i in range(0, len(signs), 2)):
            if word in _CHINESE_STOP:
                take(run, CHINESE_SIZES, "")
                run = []
            else:
                run.append(word)
        take(run, CHINESE_SIZES, "")
    return out, shouted


def _whole_heading(heading: str) -> str:
    """As normalize_term."""
    plain = re.sub(" +", " ", _NO_TERM.sub(" ", fold(heading))).strip("-' ")
    return plain.replace(" ", "") if _IDEOGRAPH.search(plain) and not _LETTER.search(plain) else plain


def group_table(chunks: DataFrame, group: str, text: str) -> DataFrame:
    """chunks: one row per chunk_id, with section_title and section_path. (group, term, frequency, chunk_frequency, heading_frequency, shouted).

    The terms of texts and headings of each group, as candidates and heading_candidates count them together; shouted of them are written as acronyms.
    Chunks are brought together by group and a task sums what is next to each other, so no candidate of a single chunk is shuffled or written.
    A large group lies in several tasks; their sums are added up after.
    """
    rows = chunks.select(group, "chunk_id", F.coalesce(text, F.lit("")).alias("_text"), _headings().alias("_heads"))
    rows = rows.repartitionByRange(group, "chunk_id").sortWithinPartitions(group).select(group, "_text", "_heads")
    kind = chunks.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size, last = 0, None

        def hand_on() -> Iterator[pa.RecordBatch]:
            for key, (n, chunk, head, loud) in held.items():
                if n:
                    terms = list(n)
                    columns = [pa.array([key] * len(terms), arrow), pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in (n, chunk, head, loud))]
                    yield pa.RecordBatch.from_arrays(columns, names=[group, "term", "frequency", "chunk_frequency", "heading_frequency", "shouted"])
            held.clear()

        for batch in batches:
            arrow = batch.schema.field(0).type
            for key, text, headings in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, chunk, head, loud = held.setdefault(key, (Counter(), Counter(), Counter(), Counter()))
                before = len(n)
                found, shouted = grams(text)
                n.update(found)
                loud.update(shouted)
                here = set(found)
                for h in headings or ():
                    parts, shouted = grams(h)
                    weights = Counter({t: 4 * k for t, k in Counter(parts).items()})
                    loud.update({t: 4 * k for t, k in Counter(shouted).items()})
                    whole = _whole_heading(h)
                    weights[whole] += 8
                    if _ACRONYM.fullmatch(h.strip(_EDGES)):
                        loud[whole] += 8
                    n.update(weights)
                    head.update(weights)
                    here.update(weights)
                chunk.update(here)
                size += len(n) - before
                if size > HELD_TERMS:
                    yield from hand_on()
                    size = 0
        if held:
            yield from hand_on()

    counted = rows.mapInArrow(run, f"`{group}` {kind}, {_COUNTS}").where(valid_candidate(F.col("term")))
    return cut_packed(counted.groupBy(group, "term").agg(*(F.sum(c).alias(c) for c in ("frequency", "chunk_frequency", "heading_frequency", "shouted"))))


def table_terms(table: DataFrame, group: str, least_chunks: int = 2) -> DataFrame:
    """table: a group_table. Scored terms of each group as cluster_terms gives them."""
    # an acronym is the term in capitals, so of equal counts the term is the later spelling
    shown = F.when(F.sum("shouted") * 2 > F.sum("frequency"), F.upper("term")).otherwise(F.col("term"))
    whole = table.groupBy("term").agg(F.sum("frequency").alias("everywhere"), shown.alias("text"))
    totals = cut_lineage(table.groupBy(group).agg(F.sum("frequency").alias("total")))
    mean = totals.agg((F.sum("total") / F.count("*")).alias("mean"))
    kept = table.where(F.col("chunk_frequency") >= least_chunks).join(whole, "term").join(totals, group).crossJoin(F.broadcast(mean))
    return _ranked(kept, group)


def _ranked(out: DataFrame, group: str) -> DataFrame:
    score = F.col("frequency") / F.greatest("total", F.lit(1)) * F.log1p(F.col("mean") / F.greatest("everywhere", F.lit(1))) * (1 + F.lit(0.12) * F.log1p("chunk_frequency"))
    out = out.select(group, "term", "text", F.round(score, 8).alias("score"), "frequency", "chunk_frequency", F.coalesce("heading_frequency", F.lit(0)).alias("heading_frequency"), detect_language(F.col("term")).alias("language"))
    order = Window.partitionBy(group).orderBy(F.desc(F.col("heading_frequency") > 0), F.desc("score"), F.desc("chunk_frequency"), "term")
    return out.withColumn("rank", F.row_number().over(order))


def cluster_terms(counts: DataFrame, group: str, chunk: str | None, headings: DataFrame | None = None, least_chunks: int = 2) -> DataFrame:
    """counts: group, chunk, term, display, n; with chunk None a candidate_table. Scored terms of each group, best first (rank).

    The counts are summed per (group, term) once and kept; all further numbers come from that small table.
    """
    if chunk is None:
        counts = cut_lineage(counts)
        table = counts.groupBy(group, "term").agg(F.sum("n").alias("frequency"), F.sum("chunks").alias("chunk_frequency"))
    else:
        per_chunk = counts.groupBy(group, chunk, "term").agg(F.sum("n").alias("n"))
        table = per_chunk.groupBy(group, "term").agg(F.sum("n").alias("frequency"), F.count("*").alias("chunk_frequency"))
    forms = counts.groupBy(group, "term", "display").agg(F.sum("n").alias("k")).groupBy("term", "display").agg(F.sum("k").alias("k"))
    shown = forms.groupBy("term").agg(F.max_by("display", F.struct("k", "display")).alias("text"))
    table = cut_lineage(table)
    everywhere = table.groupBy("term").agg(F.sum("frequency").alias("everywhere"))
    totals = table.groupBy(group).agg(F.sum("frequency").alias("total"))
    mean = totals.agg((F.sum("total") / F.count("*")).alias("mean"))
    head = headings.groupBy(group, "term").agg(F.sum("n").alias("heading_frequency")) if headings is not None else table.select(group, "term", F.lit(0).cast("long").alias("heading_frequency")).limit(0)
    out = table.where(F.col("chunk_frequency") >= least_chunks).join(everywhere, "term").join(totals, group).crossJoin(F.broadcast(mean)).join(shown, "term").join(head, [group, "term"], "left")
    return _ranked(out, group)


def term_features(term: str) -> frozenset[str]:
    """Words of a Latin term, pairs of signs of another."""
    if not any("㐀" <= c <= "䶿" or "一" <= c <= "鿿" for c in term):
        return frozenset(term.split())
    term = term.replace(" ", "")
    return frozenset([term]) if len(term) <= 2 else frozenset(term[i : i + 2] for i in range(len(term) - 1))


def likeness(a: frozenset[str], b: frozenset[str]) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def pick_diverse(terms: list[str], limit: int = TERMS) -> list[int]:
    """Positions of the terms kept in order of rank: none too like one kept before."""
    kept, features = [], []
    for i, term in enumerate(terms):
        mine = term_features(term)
        if all(likeness(mine, other) < SIMILAR for other in features):
            kept.append(i)
            features.append(mine)
            if len(kept) == limit:
                break
    return kept


def diverse_terms(ranked: DataFrame, group: str, limit: int = TERMS, reach: int = 4096) -> DataFrame:
    """The diverse best terms of each group.

    A group's terms are taken in blocks of `reach` ranks (the first smaller, as most groups are full by then); groups whose
    block doesn't fill the limit go on with the next block, so no group is gathered whole and none is cut short.
    """
    ranked = cut_packed(ranked)
    schema, reach = ranked.schema, min(reach, 8 * limit)

    def pick(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        return rows.take(pa.array(pick_diverse(rows.column("term").to_pylist(), limit), pa.int64()))

    kept = ranked.where(F.col("rank") <= reach).groupBy(group).applyInArrow(pick, schema)
    while True:
        kept = cut_lineage(kept)
        short = kept.groupBy(group).count().where(F.col("count") < limit).select(group)
        more = ranked.join(short, group, "left_semi").where((F.col("rank") > reach) & (F.col("rank") <= 2 * reach))
        if more.isEmpty():
            return kept
        kept = kept.unionByName(more).groupBy(group).applyInArrow(pick, schema)
        reach *= 2


def with_fallback(selected: DataFrame, counts: DataFrame, group: str) -> DataFrame:
    """Groups without a scored term get their most frequent one with score 0. counts: candidates of chunks, or a group_table."""
    table = counts if "chunk_frequency" in counts.columns else counts.groupBy(group, "term").agg(F.sum("n").alias("frequency"), F.countDistinct("chunk_id").alias("chunk_frequency"))
    left = table.join(selected.select(group).distinct(), group, "left_anti")
    best = left.groupBy(group).agg(F.max_by(F.struct("term", "frequency", "chunk_frequency"), F.struct("frequency", "term")).alias("b")).select(group, "b.*")
    filled = best.select(group, "term", F.col("term").alias("text"), F.lit(0.0).alias("score"), "frequency", "chunk_frequency", F.lit(0).cast("long").alias("heading_frequency"), detect_language(F.col("term")).alias("language"), F.lit(1).alias("rank"))
    return selected.select(*filled.columns).unionByName(filled)


def term_rows(selected: DataFrame, group: str) -> DataFrame:
    """Term nodes of the selected terms, with the match type."""
    return selected.withColumn("match_type", match_type(F.col("term"), F.col("language"))).withColumnRenamed("term", "normalized_text").withColumnRenamed("score", "ctfidf_score").withColumnRenamed(group, "concept_id")


def mentions(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """chunks: chunk_id, text, retrieval_text. terms: term_id, text, match_type. MENTIONS_TERM edges.

    One scan of the texts for all terms; the joined part is what was found only.
    """
    bodies = chunks.select(F.col("chunk_id").alias("id"), F.coalesce("retrieval_text", "text").alias("body"), F.coalesce("text", F.lit("")).alias("source"))
    named = terms.where("text <> ''").select("term_id", F.col("text").alias("body"), (F.col("match_type") == "word").alias("word"))
    found = occurrences(bodies, named)
    scope = F.when(F.col("source_count") > 0, "source_text").otherwise("section_context")
    return found.join(terms.select("term_id", F.col("text").alias("matched_text"), "match_type"), "term_id").select(F.col("id").alias("chunk_id"), "term_id", "matched_text", "match_type", "count", "source_count", scope.alias("match_scope"))


def concept_mentions(mentions: DataFrame, terms: DataFrame, least: float = MENTION_SHARE) -> DataFrame:
    """MENTIONS_CONCEPT edges derived from term mentions: a concept counts where its strongest term found is near its strongest term."""
    weight = F.coalesce("evidence_weight", F.lit(0.0))
    owned = terms.select("term_id", "concept_id", weight.alias("w"))
    top = owned.groupBy("concept_id").agg(F.max("w").alias("top"))
    found = mentions.join(owned, "term_id").groupBy("chunk_id", "concept_id").agg(
        F.sum("count").alias("count"), F.sum("source_count").alias("source_count"), F.array_sort(F.collect_set("matched_text")).alias("matched_terms"), F.max("w").alias("evidence_weight")
    )
    confidence = F.when(F.col("top") > 0, F.col("evidence_weight") / F.col("top")).otherwise(0.0)
    return found.join(top, "concept_id").withColumn("confidence", confidence).where(F.col("confidence") >= least).drop("top")

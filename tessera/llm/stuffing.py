"""Problem 8: pages of repeated keywords, links or tags instead of sentences.

A page is cut into blocks of some lines. Each block gives content and link features (how it
compresses, how its words and word pairs repeat, shares of kinds of characters, lengths of
words and lines, addresses) and, from signals that are none of the features, a weak label:
clauses held together by function words, and numbered or priced entries, are text; blocks
with next to none of either are not. Bagged decision trees are fitted on a bounded sample of
labelled blocks and predict every block. A page's prediction is the share of its characters
in such blocks. It is then smoothed with the share of such pages at the page's source: its
log odds move by part of the source's log odds against the corpus.

Defined cases: null, empty and blank texts are no such pages; a null source is a source of
its own; each copy of a page counts; character forms that look the same count as one; where
weak labels of one kind only are seen there is nothing to learn, and no page is found.
"""

from __future__ import annotations

import functools
import math
import re
import sys
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chunks import in_slices
from tessera.llm.lookalike import skeleton
from tessera.plans.runtime import cut_lineage, read_table, spread

#: Labelled blocks of either kind the trees are fitted on at most (one a page); trees and their depth.
SAMPLE, TREES, DEPTH, LEAST_LEAF = 5000, 40, 12, 3
#: Difference of prediction and label from which on a block is taken into the second sample.
DOUBT = 0.25
#: Bytes a block holds at least, and those of a line that is cut in two.
BLOCK, LONG_LINE = 400, 900
#: Weight of the source's log odds, and pages a source's rate is shrunk by towards the corpus.
SOURCE_WEIGHT, SOURCE_PSEUDO = 0.25, 50.0
#: A page's share is kept this far from 0 and 1 before its log odds are taken.
SHARE_EDGE = 0.02
#: Sources up to this many (two numbers and a name each) are broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 100_000

#: Closed-class words, by which clauses of these languages are known.
FUNCTION_WORDS = frozenset((
    "the", "of", "to", "and", "a", "an", "in", "that", "is", "are", "be", "by", "for", "or", "as", "on", "with", "at", "any", "its", "which", "may", "must", "shall", "should", "will", "has", "have", "if",
    "than", "from", "under", "unless", "where", "when", "before", "after", "within", "during", "not", "no", "this", "these", "their", "it", "was", "were", "into", "upon", "other", "each", "every", "all",
    "der", "die", "das", "den", "dem", "des", "und", "ist", "von", "zu", "nach", "vor", "auf", "soll", "darf", "muss", "kann", "bis", "im", "mit", "für", "oder", "ein", "eine", "einer", "über",
    "le", "la", "les", "l", "de", "du", "d", "et", "à", "un", "une", "par", "est", "au", "aux", "dans", "sur", "avec", "pour", "ne", "pas", "sans", "en", "que", "qui", "doit", "peut",
    "को", "की", "के", "का", "से", "में", "है", "और", "पर", "हर",
))
#: Function characters of Chinese and Japanese, function words of Thai.
_SIGNS = re.compile("[的須應以及而其不將為於是在所或但且由與至如則向仍乃之若はをのにがとでも]|ต้อง|ควร|อาจ|จะ|ภายใน|โดย|ก่อน|ทุก|ตาม|และ|ของ|ที่")
#: Letters of scripts whose function words are not stated: no label says that such a block is no text.
_UNKNOWN = re.compile("[\u0370-\u08ff\u0980-\u0dff\u0e80-\u1dff\uac00-\ud7a3]")
_CLAUSE = re.compile(r"[.!?;:。！？；：।\n]+")
#: Letters and digits with the vowel signs and marks that Python holds for no word characters.
_TOKEN = re.compile(r"[\w\u0300-\u036f\u0900-\u0963\u0e31-\u0e4e]+")
_ENTRY = re.compile(r"\s*(?:[•●▪◦*](?!.*://)|\(?(?:\d{1,3}|[ivxlc]{1,5}|[a-z])[.)]\s|[（(][一二三四五六七八九十]+[）)]|\d+(?:\.\d+)+\.?\s|\[\d+\])|.*(?:\.{3,}|…{2,}|\t|\s{3,})\s*\S*\d\S*(?:\s\w+){0,2}\s*$", re.I)
_WIDE = re.compile("[㐀-䶿一-鿿豈-﫿぀-ヿ]")

FEATURES = (
    "compression", "entropy", "distinct", "distinct_pairs", "top_share", "word_length", "word_spread", "short_words", "long_words", "line_length", "line_spread", "same_starts", "same_ends",
    "length_by_count", "common_length", "digits", "capitals", "marks", "stops", "blanks", "wide", "joined", "mixed", "addresses",
)
OTHER, SMALL, CAPITAL, WIDE, DIGIT, STOP, BLANK, MARK = range(8)


@functools.cache
def _kinds() -> np.ndarray:
    """The kind of every code point."""
    of = {"Ll": SMALL, "Lm": SMALL, "Mn": SMALL, "Mc": SMALL, "Lu": CAPITAL, "Lt": CAPITAL, "Nd": DIGIT, "Zs": BLANK, "Cc": BLANK}
    kinds = np.fromiter((of.get(c := unicodedata.category(chr(i)), MARK if c[0] in "PS" else WIDE if c == "Lo" else OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    kinds[[ord(c) for c in ".,;:!?。，、；：！？।"]] = STOP
    return kinds


def blocks_of(text: str) -> list[str]:
    """The page in blocks of whole lines; a line that is long by itself is cut at its blanks or stops."""
    pieces = []
    for line in text.splitlines():
        if not line.strip():
            continue
        size = len(line.encode("utf-8", "replace"))
        if size <= LONG_LINE:
            pieces.append((line, size))
            continue
        step = max(1, len(line) * BLOCK // size)
        low = 0
        while low < len(line):
            high = low + step
            if len(line) - high < step:
                high = len(line)
            else:
                cut = max(line.rfind(c, low + step // 2, high) for c in " 。、，|")
                high = cut + 1 if cut >= 0 else high
            pieces.append((line[low:high], BLOCK))
            low = high
    out, held, width = [], [], 0
    for piece, size in pieces:
        held.append(piece)
        width += size
        if width >= BLOCK:
            out.append("\n".join(held))
            held, width = [], 0
    if held:
        rest = "\n".join(held)
        if out and width < BLOCK // 2:
            out[-1] += "\n" + rest
        else:
            out.append(rest)
    return out


def _words(block: str) -> list[str]:
    """Words in one case; of a run of ideographs, its pairs, since the script does not part words."""
    words = _TOKEN.findall(block.lower())
    if not _WIDE.search(block):
        return words
    out = []
    for t in words:
        if len(t) > 2 and _WIDE.match(t):
            out += map(str.__add__, t, t[1:])
        else:
            out.append(t)
    return out


def _means(of: np.ndarray, values: np.ndarray, blocks: int) -> np.ndarray:
    """The mean of the values of each block; 0 where it has none."""
    return np.bincount(of, values, blocks) / np.maximum(np.bincount(of, minlength=blocks), 1)


def _relative_spread(of: np.ndarray, values: np.ndarray, blocks: int) -> np.ndarray:
    mean = _means(of, values, blocks)
    return np.sqrt(np.maximum(_means(of, values * values, blocks) - mean * mean, 0)) / (mean + 1e-9)


def features(blocks: list[str]) -> np.ndarray:
    """Content and link features of each block; what is counted per character or word is counted for all blocks at once."""
    k = len(blocks)
    if not k:
        return np.zeros((0, len(FEATURES)), np.float32)
    sizes, lengths, counts, pairs, top, widths, same, packed = [], [], [], [], [], [], [], []
    for block in blocks:
        words = _words(block)
        held = Counter(words)
        lengths.append(list(map(len, held)))
        counts.append(list(held.values()))
        pairs.append(len(set(zip(words, words[1:], strict=False))))
        common = [len(w) for w, _ in held.most_common(5)]
        top.append(sum(common) / max(len(common), 1))
        lines = [line for s in block.split("\n") if (line := s.strip())]
        widths.append(list(map(len, lines)))
        same.append((1 - len({s[:6] for s in lines}) / max(len(lines), 1), 1 - len({s[-6:] for s in lines}) / max(len(lines), 1)))
        raw = block.encode("utf-8", "replace")
        packed.append(len(zlib.compress(raw, 1)) / (len(raw) + 12))
        sizes.append(len(block))
    # characters; a block ends in a line break of its own
    code = np.frombuffer(("\n".join(blocks) + "\n").encode("utf-32-le", "replace"), np.uint32)
    kind = _kinds()[code]
    at = np.repeat(np.arange(k), np.array(sizes) + 1)
    size = np.array(sizes, float)
    share = np.bincount(at * 8 + kind, minlength=8 * k).reshape(k, 8) / size[:, None]
    letter, digit = (kind == SMALL) | (kind == CAPITAL) | (kind == WIDE), kind == DIGIT
    part = letter | digit
    of = lambda where, shift: np.bincount(at[: len(at) - shift][where], minlength=k)
    joins = (code == 45) | (code == 95) | (code == 47)
    joined = of(part[:-2] & joins[1:-1] & part[2:], 2)
    mixed = of((letter[:-1] & digit[1:]) | (digit[:-1] & letter[1:]), 1)
    address = of(part[:-3] & (code[1:-2] == 46) & (kind[2:-1] == SMALL) & (kind[3:] == SMALL), 3) + of((code[:-2] == 58) & (code[1:-1] == 47) & (code[2:] == 47), 2)
    address = address + of(((code[:-1] == 60) & ((kind[1:] == SMALL) | (code[1:] == 47))) | ((code[:-1] == 93) & (code[1:] == 40)), 1)
    # distinct words with their counts, and lines
    flat = lambda v: np.array(list(chain.from_iterable(v)), float)
    own = np.repeat(np.arange(k), list(map(len, counts)))
    n, w = flat(counts), flat(lengths)
    words = np.maximum(np.bincount(own, n, k), 1)
    p = n / words[own]
    mean = np.bincount(own, n * w, k) / words
    spread = np.sqrt(np.maximum(np.bincount(own, n * w * w, k) / words - mean * mean, 0)) / (mean + 1e-9)
    most = np.zeros(k)
    np.maximum.at(most, own, p)
    log = np.log(n)
    u, v = w - _means(own, w, k)[own], log - _means(own, log, k)[own]
    tie = np.bincount(own, u * v, k) / (np.sqrt(np.bincount(own, u * u, k) * np.bincount(own, v * v, k)) + 1e-9)
    line, width = np.repeat(np.arange(k), list(map(len, widths))), flat(widths)
    same = np.array(same)
    columns = (
        packed, -np.bincount(own, p * np.log2(p), k) / np.maximum(np.log2(words), 1), np.bincount(own, minlength=k) / words, np.array(pairs) / np.maximum(words - 1, 1), most,
        mean, spread, np.bincount(own, n * (w <= 3), k) / words, np.bincount(own, n * (w >= 9), k) / words, np.log1p(_means(line, width, k)), _relative_spread(line, width, k), same[:, 0], same[:, 1],
        tie, np.array(top) / (_means(own, w, k) + 1e-9), share[:, DIGIT], share[:, CAPITAL], share[:, MARK], share[:, STOP], share[:, BLANK], share[:, WIDE], joined / words, mixed / words, address / words,
    )
    return np.column_stack(columns).astype(np.float32)


def weak_label(block: str) -> int:
    """0: most of it is clauses or entries; 1: next to none of it is either; -1: in doubt. A clause has two function words at least."""
    total = clauses = entries = 0
    for line in block.split("\n"):
        total += len(line)
        if _ENTRY.match(line):
            entries += len(line)
            continue
        ascii_only = line.isascii()
        for part in _CLAUSE.split(line):
            held = len(FUNCTION_WORDS.intersection(part.lower().split()))
            if not ascii_only:
                held += len(set(_SIGNS.findall(part)))
            if held >= 2 and len(part) <= 90 * held:
                clauses += len(part)
    known = (clauses + entries) / max(total, 1)
    return 0 if known >= 0.7 else 1 if known <= 0.1 and total >= 80 and not _UNKNOWN.search(block) else -1


class Trees:
    """Bagged classification trees as flat arrays: feature, threshold, left, right, value; how often rows are told right by the trees that have not seen them."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.trees = []
        votes, seen = np.zeros(len(x)), np.zeros(len(x))
        for _ in range(TREES):
            rows = rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []
            self._grow(x[rows], y[rows].astype(float), rng, nodes, 0)
            self.trees.append(np.array(nodes))
            out = np.setdiff1d(np.arange(len(x)), rows)
            votes[out] += self._values(self.trees[-1], x[out])
            seen[out] += 1
        left = seen > 0
        self.out_of_bag = float(((votes[left] / seen[left] > 0.5) == (y[left] > 0.5)).mean()) if left.any() else float("nan")

    def _grow(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, nodes: list, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y.mean())])
        if depth == DEPTH or len(y) < 2 * LEAST_LEAF or y.min() == y.max():
            return at
        best = (y.var() * len(y) - 1e-9, -1, 0.0)
        for j in rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False):
            # midpoints between neighbouring values of a random subset of places
            order = np.argsort(x[:, j], kind="stable")
            v, s = x[order, j], np.cumsum(y[order])
            places = np.flatnonzero(v[1:] > v[:-1]) + 1
            places = places[(places >= LEAST_LEAF) & (places <= len(y) - LEAST_LEAF)]
            if not len(places):
                continue
            n = len(y)
            left, right = s[places - 1], s[-1] - s[places - 1]
            cost = left * (1 - left / places) + right * (1 - right / (n - places))
            k = int(cost.argmin())
            if cost[k] < best[0]:
                best = (float(cost[k]), int(j), float((v[places[k] - 1] + v[places[k]]) / 2))
        if best[1] < 0:
            return at
        right = x[:, best[1]] > best[2]
        nodes[at][0], nodes[at][1] = best[1], best[2]
        nodes[at][2] = self._grow(x[~right], y[~right], rng, nodes, depth + 1)
        nodes[at][3] = self._grow(x[right], y[right], rng, nodes, depth + 1)
        return at

    @staticmethod
    def _values(t: np.ndarray, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            inner = t[at, 0] >= 0
            if not inner.any():
                break
            right = x[np.arange(len(x)), np.maximum(t[at, 0], 0).astype(np.int64)] > t[at, 1]
            at = np.where(inner, np.where(right, t[at, 3], t[at, 2]).astype(np.int64), at)
        return t[at, 4]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sum(self._values(t, x) for t in self.trees) / len(self.trees)


def _lists(values: np.ndarray, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)), pa.array(values))


def page_blocks(df: DataFrame) -> DataFrame:
    """(doc_id, source, sizes, labels, x) of every page that holds something: of each block its characters, weak label and features (one after another)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 250):
            kept, counts, sizes, labels, held = [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                blocks = blocks_of(skeleton(text)) if text and text.strip() else []
                if blocks:
                    kept.append(i)
                    counts.append(len(blocks))
                    sizes += map(len, blocks)
                    labels += map(weak_label, blocks)
                    held += blocks
            take = pa.array(kept, pa.int32())
            x = features(held).ravel()
            lists = [_lists(np.array(sizes, np.int32), counts), _lists(np.array(labels, np.int32), counts), _lists(x, [n * len(FEATURES) for n in counts])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *lists], names=["doc_id", "source", "sizes", "labels", "x"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return spread(df.select("doc_id", "source", "text")).mapInArrow(run, f"doc_id {kind}, source string, sizes array<int>, labels array<int>, x array<float>")


def _labelled(label: Column, i: Column) -> Column:
    return F.element_at("labels", i) == label


def fit(pages: DataFrame) -> Trees | None:
    """Trees fitted on labelled blocks (one a page, SAMPLE of either label), then again with up to SAMPLE of the blocks they tell wrong or doubtfully."""
    width = len(FEATURES)
    sample = []
    for label in (0, 1):
        places = F.filter(F.sequence(F.lit(1), F.size("labels")), functools.partial(_labelled, F.lit(label)))
        at = F.element_at(places, (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.size(places)) + 1).cast("int"))
        rows = pages.where(F.array_contains("labels", label)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select(F.slice("x", (at - 1) * width + 1, width))
        sample += [(r[0], label) for r in rows.collect()]
    if len({label for _, label in sample}) < 2:
        return None
    learnt = Trees(np.array([r[0] for r in sample]), np.array([r[1] for r in sample]))
    first = pages.sparkSession.sparkContext.broadcast(learnt)

    def doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            labels = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            known = labels >= 0
            labels, x = labels[known], x[known]
            hard = np.abs(first.value.predict(x) - labels) > DOUBT
            n = int(hard.sum())
            yield pa.RecordBatch.from_arrays([pa.array(labels[hard]), _lists(x[hard].ravel(), [width] * n)], names=["label", "x"])

    rows = pages.select("labels", "x").mapInArrow(doubtful, "label int, x array<float>")
    more = rows.orderBy(F.xxhash64("x", "label")).limit(SAMPLE).collect()
    if more:
        sample += [(r[1], r[0]) for r in more]
        learnt = Trees(np.array([r[0] for r in sample]), np.array([r[1] for r in sample]))
    return learnt


def predicted(pages: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, source, page_score): the share of a page's characters in blocks that are no text, by the trees."""
    held = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            if not batch.num_rows:
                continue
            counts = np.diff(batch.column(2).offsets.to_numpy())
            sizes = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float)
            p = held.value.predict(batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)))
            first = np.concatenate([[0], np.cumsum(counts)[:-1]])
            share = np.add.reduceat(p * sizes, first) / np.add.reduceat(sizes, first)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share)], names=["doc_id", "source", "page_score"])

    kind = pages.schema["doc_id"].dataType.simpleString()
    return pages.select("doc_id", "source", "sizes", "x").mapInArrow(run, f"doc_id {kind}, source string, page_score double")


def smoothed(pages: DataFrame) -> DataFrame:
    """pages: doc_id, source, page_score. Adds score: the log odds moved by what the source holds against the corpus."""
    rates = cut_lineage(pages.groupBy("source").agg(F.sum("page_score").alias("s"), F.count("*").alias("n")))
    total = rates.agg(F.sum("s"), F.sum("n"), F.count("*")).first()
    overall = min(max((total[0] or 0.0) / max(total[1] or 1, 1), 1e-4), 1 - 1e-4)
    rate = (F.col("s") + F.lit(SOURCE_PSEUDO * overall)) / (F.col("n") + F.lit(SOURCE_PSEUDO))
    odds = lambda p: F.log(p / (F.lit(1.0) - p))
    shift = rates.select(F.col("source").alias("at"), (F.lit(SOURCE_WEIGHT) * (odds(rate) - F.lit(math.log(overall / (1 - overall))))).alias("shift"))
    if total[2] <= BROADCAST_SOURCES:
        shift = F.broadcast(shift)
    near = F.least(F.greatest(F.col("page_score"), F.lit(SHARE_EDGE)), F.lit(1 - SHARE_EDGE))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(odds(near) + F.col("shift"))))
    return pages.join(shift, F.col("source").eqNullSafe(F.col("at"))).select("doc_id", "source", "page_score", score.alias("score"))


def scores(df: DataFrame) -> DataFrame:
    """(doc_id, source, page_score, score) of every page that holds something: the trees' prediction and the smoothed one."""
    pages = cut_lineage(page_blocks(df))
    trees = fit(pages)
    if trees is None:
        return pages.select("doc_id", "source", F.lit(0.0).alias("page_score"), F.lit(0.0).alias("score"))
    return smoothed(cut_lineage(predicted(pages, trees)))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(read_table(spark, sf_dir, "documents")).where("score > 0.5").select("doc_id")


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and found pages by source."""
    return scores(read_table(spark, sf_dir, "documents")).groupBy("source").agg(F.count("*").alias("n_pages"), F.count_if(F.col("score") > 0.5).alias("n_found"))


QUERIES = {"p8_found": p8_found, "p8_sources": p8_sources}
ORACLE: dict[str, str] = {}

"""Problem 3: cutting oversized texts at natural boundaries.

Dynamic programming over boundary positions: a piece costs the penalty of the boundary it
ends at and the square of its distance from the target size; pieces above the maximum are
not allowed. Each next piece starts a given overlap earlier, at a natural boundary where
one lies in the second half of the overlap. The size of any span is read from prefix
counts, since the token estimate adds up over spans that do not cut a Latin word.

Defined cases: null texts give no piece; texts within the limit, also empty and blank ones,
give one piece as they are; estimated_tokens of the table is not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import CJK, WORD, estimate_tokens, exceeds_tokens
from tessera.llm.chunks import latest
from tessera.plans import sql
from tessera.plans.runtime import read_table, spread

TARGET, MAXIMUM, OVERLAP = 420, 650, 70
#: Penalties of cutting at a line break, a sentence end, a clause mark, white space, anywhere.
PENALTIES = (0.0, 0.5, 2.0, 5.0, 12.0)
_CJK = re.compile(f"[{CJK}]")
_WORD = re.compile(WORD)
_OTHER = re.compile(rf"[^\sA-Za-z0-9{CJK}]")
_LEVELS = (
    re.compile(r"\n+"),
    re.compile(r"[。！？｡]+[」』”’）\"')»]*|[.!?…।]+[」』”’）\"')»]*(?=\s)"),
    re.compile(r"[；：，、;:,](?=\s|[^\sA-Za-z0-9])"),
    re.compile(r"\s+"),
)
_MARK = re.compile(r"[̀-ͯ҃-֑҉-ׇؐ-ًؚ-ٟऀ-ः़ा-्ัิ-ฺ็-๎︀-️⃐-⃿‍]")


class Spans:
    """Sizes of spans of one text, and its possible cuts with their penalties."""

    def __init__(self, text: str):
        n = len(text)
        self.cjk, self.words, self.other = (self._prefix(n, (m.start() for m in p.finditer(text))) for p in (_CJK, _WORD, _OTHER))
        level = np.full(n + 1, 4, dtype=np.int8)
        for m in _WORD.finditer(text):
            level[m.start() + 1 : m.end()] = 9  # never inside a word
        for m in _MARK.finditer(text):
            level[m.start()] = 9  # nor before a combining sign
        for k in (3, 2, 1, 0):
            for m in _LEVELS[k].finditer(text):
                if level[m.end()] != 9 and m.end() < n:
                    level[m.end()] = k
        level[0] = level[n] = 0
        self.level, self.n = level, n

    @staticmethod
    def _prefix(n: int, at: Iterator[int]) -> np.ndarray:
        hits = np.zeros(n + 1, dtype=np.int64)
        hits[1:][np.fromiter(at, dtype=np.int64)] = 1
        return np.cumsum(hits)

    def tokens(self, a, b):
        raw = (self.cjk[b] - self.cjk[a]) + (self.words[b] - self.words[a]) * 1.3 + (self.other[b] - self.other[a]) * 0.35
        return np.maximum(1, np.ceil(raw)).astype(np.int64)

    def weight(self) -> np.ndarray:
        """Size of the text before each position, without rounding; never falls."""
        return self.cjk + self.words * 1.3 + self.other * 0.35


def _cuts(s: Spans, step: float) -> np.ndarray:
    """Line and sentence ends; where they lie further apart than step, weaker boundaries as well."""
    weight, kept = s.weight(), np.flatnonzero(s.level <= 1)
    for most in (2, 3, 4):
        gaps = np.flatnonzero(np.diff(weight[kept]) > step)
        if not len(gaps):
            break
        more = []
        for g in gaps:
            a, b = kept[g], kept[g + 1]
            inside = a + 1 + np.flatnonzero(s.level[a + 1 : b] <= most)
            if len(inside) and most > 2:  # as many as the step needs, evenly
                wanted = np.arange(weight[a] + step / 4, weight[b], step / 4)
                inside = inside[np.unique(np.minimum(np.searchsorted(weight[inside], wanted), len(inside) - 1))]
            more.append(inside)
        kept = np.unique(np.concatenate([kept, *more]))
    return kept


def _starts(s: Spans, cuts: np.ndarray, overlap: int) -> np.ndarray:
    """Where the piece after each cut starts: at most overlap tokens earlier."""
    starts = cuts.copy()
    if overlap <= 0:
        return starts
    weight = s.weight()
    for k, cut in enumerate(cuts[1:-1], 1):
        low = int(np.searchsorted(weight, weight[cut] - overlap - 1e-9))
        span = np.arange(low, cut)
        span = span[(s.level[span] != 9)]
        size = s.tokens(span, cut)
        fits = size <= overlap
        span, size = span[fits], size[fits]
        if len(span):
            near = np.where(size * 2 >= overlap, np.asarray(PENALTIES)[s.level[span]], 20.0)
            starts[k] = span[np.argmin(near + 3.0 * (overlap - size) / overlap)]
    return starts


def split_spans(text: str, target: int = TARGET, maximum: int = MAXIMUM, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces; each within maximum tokens, together covering the text."""
    s = Spans(text)
    if s.tokens(0, s.n) <= maximum:
        return [(0, s.n)]
    cuts = _cuts(s, (maximum - overlap) / 4)
    starts = _starts(s, cuts, overlap)
    penalty = np.asarray(PENALTIES)[np.minimum(s.level[cuts], 4)]
    weight = s.weight()
    best, back = np.full(len(cuts), np.inf), np.zeros(len(cuts), dtype=np.int64)
    best[0] = 0.0
    for j in range(1, len(cuts)):
        low = int(np.searchsorted(weight[cuts], weight[cuts[j]] - maximum - 1, side="left"))
        i = np.arange(low, j)
        size = s.tokens(starts[i], cuts[j])
        cost = best[i] + penalty[j] + 10.0 * ((size - target) / target) ** 2
        cost[size > maximum] = np.inf
        k = int(np.argmin(cost)) if len(i) else 0
        if len(i):
            best[j], back[j] = cost[k], i[k]
    if not math.isfinite(best[-1]):
        raise ValueError("no pieces within the maximum; is the overlap too large for it?")
    ends = [len(cuts) - 1]
    while ends[-1]:
        ends.append(int(back[ends[-1]]))
    ends.reverse()
    return [(int(starts[a]), int(cuts[b])) for a, b in zip(ends, ends[1:], strict=False)]


PIECES = "chunk_id string, split_part int, n_parts int, start_pos int, end_pos int, text string, estimated_tokens int, overlap_tokens int"


def split_oversized(df: DataFrame, target: int = TARGET, maximum: int = MAXIMUM, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the texts above the maximum; the size test runs in the JVM, so few texts reach Python."""
    if not (0 < target <= maximum and 0 <= overlap and overlap * 2 < maximum):
        raise ValueError("0 < target <= maximum and 0 <= 2 * overlap < maximum must hold")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s, spans = Spans(text), split_spans(text, target, maximum, overlap)
                last = 0
                for part, (a, b) in enumerate(spans, 1):
                    rows.append((key, part, len(spans), a, b, text[a:b], int(s.tokens(a, b)), int(s.tokens(a, last)) if last > a else 0))
                    last = b
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split(" ")[0] for f in PIECES.split(", ")])

    return df.select("chunk_id", "text").where(exceeds_tokens(F.col("text"), maximum)).mapInArrow(run, PIECES)


def split_all(df: DataFrame, target: int = TARGET, maximum: int = MAXIMUM, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every text; those within the maximum never leave the JVM."""
    text = F.col("text")
    whole = df.select("chunk_id", "text").where(text.isNotNull() & ~exceeds_tokens(text, maximum))
    whole = whole.select("chunk_id", F.lit(1).alias("split_part"), F.lit(1).alias("n_parts"), F.lit(0).alias("start_pos"), F.length(text).alias("end_pos"), "text", estimate_tokens(text).alias("estimated_tokens"), F.lit(0).alias("overlap_tokens"))
    return whole.unionByName(split_oversized(df, target, maximum, overlap))


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last loads that are above the maximum. The size test stands before the shuffle, so only oversized texts are shuffled;
    the other rows take part in the choice of the last load without their text."""
    chunks = spread(read_table(spark, sf_dir, "chunks").select("chunk_id", "text", "updated_at"))
    large = chunks.withColumn("text", F.when(exceeds_tokens(F.col("text"), MAXIMUM), F.col("text")))
    return latest(large, "chunk_id", "text").where(F.col("text").isNotNull())


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(_oversized(spark, sf_dir)).where("split_part = 1 AND n_parts > 1").select("chunk_id")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_all(latest(read_table(spark, sf_dir, "chunks"), "chunk_id", "text"))


def p3_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text put together again from its pieces without their overlaps, as a hash; whether all pieces are within the limits."""
    pieces = p3_pieces(spark, sf_dir)
    order = Window.partitionBy("chunk_id").orderBy("split_part")
    own = F.substring("text", F.greatest(F.lag("end_pos", 1, 0).over(order) - F.col("start_pos"), F.lit(0)) + 1, F.length("text"))
    held = pieces.withColumn("own", own).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("split_part", "own"))).alias("p"), F.max("estimated_tokens").alias("most"), F.max("overlap_tokens").alias("overlap"))
    whole = F.array_join(F.transform("p", lambda s: s["own"]), "")
    return held.select("chunk_id", F.sha2(whole, 256).alias("text_hash"), ((F.col("most") <= MAXIMUM) & (F.col("overlap") <= OVERLAP)).alias("within"))


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_rebuilt": p3_rebuilt}
ORACLE = {
    "p3_rebuilt": f"WITH {sql.CHUNKS} SELECT chunk_id, sha256(text) AS text_hash, true AS within FROM c WHERE text IS NOT NULL",
    "p3_found": r"""
        SELECT DISTINCT chunk_id FROM chunks WHERE text IS NOT NULL AND ceil(
            len(regexp_extract_all(text, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]'))
            + 1.3::DOUBLE * len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*'))
            + 0.35::DOUBLE * len(regexp_extract_all(text, '[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}A-Za-z0-9\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]'))) > 650"""
}

"""Problem 7: passages of held-out test items inside corpus documents.

Every item is cut into windows of its own measure (12 words; 24 characters for items of
lang zh) and every document into windows of the same size. A window's fingerprint is a
64-bit SimHash of its words. The fingerprints of the items are indexed by 4 blocks of 16
bits: two fingerprints within radius 3 agree in one block at least, so no pair within the
radius is missed, and equal windows have distance 0. Each candidate is verified by the
similarity of its weighted shingles; p7_found keeps those whose words also follow each other
exactly. (Windows that share too few shingles of ideographs to reach that similarity are not
looked up; a bound, so no verified pair is lost.)

A window of weighted shingle similarity 0.8 may lie far outside any useful radius, so
p7_similar takes its candidates from an index of the shingles (five tokens). A window that
similar leaves at most a known number of its shingles unmatched, so one of its rarest,
one more than that number, leads to it: no pair is missed. Each candidate is verified.

Case, punctuation, spacing, line breaks and characters that look the same are disregarded.
Defined cases: null or empty texts and items shorter than a window match nothing; repeated
rows of an item count once; each copy of a document counts.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import checks
from tessera.llm.chunks import in_slices
from tessera.llm.lookalike import skeleton
from tessera.plans import sql
from tessera.plans.runtime import read_table, spread

WORDS, CHARACTERS, SHINGLE, SIMILARITY, RADIUS = 12, 24, 5, 0.8, 3
BLOCKS, BLOCK_BITS = 4, 16
#: Bytes of the index of one block of items at most; each block of more items is a scan of its own. An item character takes
#: about this many bytes in the index (its share of windows, shingles and orders).
ITEM_BLOCK_BYTES, BYTES_PER_CHARACTER = 64 << 20, 160
#: Places of shingles that candidates of similar windows are taken from at once.
MOST_CANDIDATES = 1 << 20
#: Tokens of documents handled at once (a longer document is handled in overlapping slices).
SLICE = 1 << 16
#: CJK ideographs and kana, each of which counts as a word.
CJK = "㐀-䶿一-鿿豈-﫿぀-ヿ"
_TOKEN = re.compile(rf"[{CJK}]|[^\W_{CJK}]+")
_CJK = re.compile(rf"[{CJK}]")


def folded(text: str) -> str:
    text = skeleton(text).casefold()
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def words_of(text: str) -> list[str]:
    return _TOKEN.findall(text)


def characters_of(text: str) -> list[str]:
    return [c for c in text if c.isalnum()]


class Vectors:
    """Hash and ±1 vector of each token, grown as tokens appear and emptied when full."""

    def __init__(self, most: int = 300_000):
        self.most, self.at = most, {}
        self.hashes = np.zeros(1024, dtype=np.uint64)
        self.signs = np.zeros((1024, 64), dtype=np.int8)

    def of(self, tokens: list[str]) -> np.ndarray:
        """Rows of the tokens; valid until the next call."""
        if len(self.at) > self.most:
            self.at.clear()
        at = self.at
        new = [t for t in dict.fromkeys(tokens) if t not in at]
        if new:
            first = len(at)
            while first + len(new) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
                self.signs = np.concatenate([self.signs, np.zeros_like(self.signs)])
            h = np.array([xxhash.xxh64_intdigest(t.encode()) for t in new], dtype=np.uint64)
            self.hashes[first : first + len(new)] = h
            self.signs[first : first + len(new)] = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1
            at.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(at.__getitem__, tokens), dtype=np.int64, count=len(tokens))


def fingerprints(signs: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each run of size rows: sums by doubling, then one bit per column."""
    n = len(signs) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total, done, run, width = None, 0, signs, 1
    while True:
        if size & width:
            part = run[done : done + n]
            total = part.copy() if total is None else total + part
            done += width
        if width * 2 > size:
            break
        run = run[: len(run) - width] + run[width:]
        width *= 2
    return np.packbits(total > 0, axis=1).view(np.uint64).ravel()


def shingles(hashes: np.ndarray) -> np.ndarray:
    """A hash of each run of SHINGLE tokens, from the hashes of the tokens."""
    n = max(len(hashes) - SHINGLE + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(SHINGLE):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Index:
    """Fingerprints and owners of the windows of one measure, by Hamming block; tokens and shingles of the items one after another."""

    def __init__(self, items: list[tuple[int, str]], size: int, tokens_of):
        vectors = Vectors()
        prints, owners, hashes, lengths, wide, runs = [], [], [], [], [], []
        self.size, self.least_wide, self.missing = size, 0, np.zeros(1, np.int64)
        for item, text in items:
            tokens = tokens_of(text)
            if len(tokens) < size:
                continue
            at = vectors.of(tokens)
            prints.append(fingerprints(vectors.signs[at], size))
            owners.append(np.full(len(prints[-1]), item, dtype=np.int64))
            hashes.append(vectors.hashes[at])
            lengths.append(np.array([len(t) for t in tokens], dtype=np.int32))
            runs.append(shingles(hashes[-1]))
            cjk = np.array([bool(_CJK.match(t)) for t in tokens])
            wide.append(np.lib.stride_tricks.sliding_window_view(cjk, SHINGLE).any(axis=1))
        empty = not prints
        self.prints = np.zeros(0, np.uint64) if empty else np.concatenate(prints)
        self.owners = np.zeros(0, np.int64) if empty else np.concatenate(owners)
        self.tokens = np.zeros(0, np.uint64) if empty else np.concatenate(hashes)
        self.letters = np.zeros(0, np.int32) if empty else np.concatenate(lengths)
        firsts = np.cumsum([0] + [len(h) for h in hashes])
        self.first = np.zeros(0, np.int64) if empty else np.concatenate([np.arange(f, f + len(h) - size + 1) for f, h in zip(firsts, hashes)])  # first token of a window
        self.order, self.start = [], []
        for b in range(BLOCKS):
            key = self._block(self.prints, b)
            self.order.append(np.argsort(key, kind="stable"))
            self.start.append(np.searchsorted(key[self.order[-1]], np.arange((1 << BLOCK_BITS) + 1)))
        if not empty:
            weights = np.concatenate([np.lib.stride_tricks.sliding_window_view(n, SHINGLE).sum(axis=1) for n in lengths])
            self._index_shingles(runs, weights, np.concatenate(wide))

    def window(self, w: np.ndarray) -> np.ndarray:
        """Token hashes of windows, one row each."""
        return self.tokens[self.first[w][:, None] + np.arange(self.size)]

    @property
    def wide_shingles(self) -> int:
        """Shingles with ideographs that a window must share to be similar to any of the items."""
        return self.least_wide - int(self.missing.max())

    def _index_shingles(self, runs: list[np.ndarray], weights: np.ndarray, wide: np.ndarray) -> None:
        """Shingles of all items one after another, their order by hash, and how many may be missing of each window."""
        n = self.size - SHINGLE + 1
        self.runs = np.concatenate(runs)
        firsts = np.cumsum([0] + [len(r) for r in runs])
        self.at = np.concatenate([np.arange(f, f + len(r) - n + 1) for f, r in zip(firsts, runs)])  # first shingle of a window
        self.window_at = np.full(len(self.runs), -1)
        self.window_at[self.at] = np.arange(len(self.at))
        self.by_run = np.argsort(self.runs, kind="stable")
        self.sorted_runs = self.runs[self.by_run]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.runs & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.missing, self.least_wide = np.zeros(len(self.at), np.int64), n
        for low in range(0, len(self.at), 1 << 16):
            span = self.at[low : low + (1 << 16), None] + np.arange(n)
            w, r = np.sort(weights[span], axis=1).astype(float), np.sort(self.runs[span], axis=1)
            whole, repeats = w.sum(axis=1), (r[:, 1:] == r[:, :-1]).any(axis=1)
            # m foreign shingles take the place of m others, the lightest at best, and weigh the mean of the distinct ones each
            mean = np.where(repeats, w[:, 0], whole / n)[:, None] * np.arange(1, n + 1)
            fits = whole[:, None] - np.cumsum(w, axis=1) >= SIMILARITY * (whole[:, None] + mean) - 1e-6
            self.missing[low : low + (1 << 16)] = fits.sum(axis=1)
            self.least_wide = min(self.least_wide, int(wide[span].sum(axis=1).min()))

    def similar_candidates(self, hashes: np.ndarray, whole: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (window of the document, window of an item) of which few enough shingles differ; whole: windows to look at."""
        n, most = self.size - SHINGLE + 1, int(self.missing.max())
        run = shingles(hashes)
        hit = self.maybe[(run & np.uint64((1 << 22) - 1)).astype(np.int64)]
        at = np.flatnonzero(hit)
        low, count = np.zeros(len(run), np.int64), np.zeros(len(run), np.int64)
        low[at] = np.searchsorted(self.sorted_runs, run[at], side="left")
        count[at] = np.searchsorted(self.sorted_runs, run[at], side="right") - low[at]
        none = np.concatenate([[0], np.cumsum(count == 0)])
        windows = np.flatnonzero(whole & (none[n:] - none[:-n] <= most))
        # the rarest shingles of a window, one more than may be missing
        span = windows[:, None] + np.arange(n)
        rare = np.take_along_axis(span, np.argsort(count[span], axis=1, kind="stable")[:, : most + 1], axis=1) if len(windows) else span
        load = count[rare].sum(axis=1) * n if len(windows) else np.zeros(0, np.int64)
        start = 0
        while start < len(windows):
            stop = start + max(1, int(np.searchsorted(np.cumsum(load[start:]), MOST_CANDIDATES, side="right")))
            keys, reps = rare[start:stop].ravel(), count[rare[start:stop]].ravel()
            doc = np.repeat(np.repeat(windows[start:stop], rare.shape[1]), reps)
            ends = np.cumsum(reps)
            place = self.by_run[np.repeat(low[keys] - (ends - reps), reps) + np.arange(ends[-1])]
            first = place[:, None] - np.arange(n)
            item = np.where(first >= 0, self.window_at[np.maximum(first, 0)], -1).ravel()
            doc = np.repeat(doc, n)[item >= 0]
            pairs = np.unique(doc * len(self.at) + item[item >= 0])
            doc, item = pairs // len(self.at), pairs % len(self.at)
            for k in range(0, len(doc), 1 << 15):
                d, i = doc[k : k + (1 << 15)], item[k : k + (1 << 15)]
                mine, theirs = run[d[:, None] + np.arange(n)], self.runs[self.at[i][:, None] + np.arange(n)]
                near = n - (mine[:, :, None] == theirs[:, None, :]).any(axis=2).sum(axis=1) <= self.missing[i]
                yield d[near], i[near]
            start = stop

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(BLOCK_BITS * b)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (position, window of an item) within the radius."""
        found = []
        for b in range(BLOCKS):
            key = self._block(prints, b)
            low, count = self.start[b][key], self.start[b][key + 1] - self.start[b][key]
            who = np.repeat(np.arange(len(prints)), count)
            if not len(who):
                continue
            ends = np.cumsum(count)
            window = self.order[b][np.repeat(low - (ends - count), count) + np.arange(ends[-1])]
            close = np.bitwise_count(prints[who] ^ self.prints[window]) <= RADIUS
            found.append(who[close] * len(self.prints) + window[close])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return (pairs // len(self.prints), pairs % len(self.prints)) if len(pairs) else (pairs, pairs)

    def similarity(self, doc: np.ndarray, window: int) -> float:
        """Weighted Jaccard similarity of five-word shingles; a shingle weighs its letters."""
        first = self.first[window]
        item, letters = self.tokens[first : first + self.size], self.letters[first : first + self.size]
        mine, theirs, weight = Counter(), Counter(), {}
        for i in range(self.size - SHINGLE + 1):
            k = item[i : i + SHINGLE].tobytes()
            mine[k] += 1
            weight[k] = int(letters[i : i + SHINGLE].sum())
            theirs[doc[i : i + SHINGLE].tobytes()] += 1
        mean = sum(weight.values()) / len(weight)
        both = sum(weight[k] * min(n, theirs[k]) for k, n in mine.items())
        return both / sum(weight.get(k, mean) * max(mine[k], theirs[k]) for k in mine | theirs)


def _matches(streams: list[list[str]], index: Index, vectors: Vectors, exact: bool) -> list[set[int]]:
    """The items that each stream of tokens reveals."""
    out: list[set[int]] = [set() for _ in streams]
    size = index.size
    if not len(index.prints):
        return out

    def flush(tokens: list[str], owner: list[int]) -> None:
        if len(tokens) < size:
            return
        at = vectors.of(tokens)
        who = np.array(owner)
        whole = who[: len(who) - size + 1] == who[size - 1 :]
        if not exact:
            for doc, item in index.similar_candidates(vectors.hashes[at], whole):
                for d, i in zip(doc.tolist(), item.tolist(), strict=True):
                    leak = int(index.owners[i])
                    if leak not in out[who[d]] and index.similarity(vectors.hashes[at[d : d + size]], i) >= SIMILARITY:
                        out[who[d]].add(leak)
            return
        if index.wide_shingles > 0:
            # a window with fewer shingles of ideographs than must be shared is similar to no item
            cjk = np.concatenate([[0], np.cumsum([bool(_CJK.match(t)) for t in tokens])])
            held = np.concatenate([[0], np.cumsum(cjk[SHINGLE:] > cjk[:-SHINGLE])])
            n = size - SHINGLE + 1
            whole &= held[n:] - held[:-n] >= index.wide_shingles
        kept = np.flatnonzero(whole)
        if not len(kept):
            return
        position, window = index.near(fingerprints(vectors.signs[at], size)[kept])
        if not len(position):
            return
        hashes = vectors.hashes[at]
        runs = np.lib.stride_tricks.sliding_window_view(hashes, size)[kept[position]]
        same = (runs == index.window(window)).all(axis=1)
        for k in range(len(position)):
            leak, d = int(index.owners[window[k]]), kept[position[k]]
            if leak not in out[who[d]] and index.similarity(hashes[d : d + size], int(window[k])) >= SIMILARITY and same[k]:
                out[who[d]].add(leak)

    tokens, owner = [], []
    for i, stream in enumerate(streams):
        for low in range(0, max(len(stream) - size + 1, 1), SLICE):
            part = stream[low : low + SLICE + size - 1]
            tokens += part
            owner += [i] * len(part)
            if len(tokens) >= SLICE:
                flush(tokens, owner)
                tokens, owner = [], []
    flush(tokens, owner)
    return out


#: The indexes of the last block of items, kept in a worker that serves several tasks.
_built: dict = {}


def _indexes(key: str, held) -> tuple[Index, Index]:
    if _built.get("key") != key:
        _built.clear()
        _built.update(key=key, pair=(Index([(i, t) for i, lang, t in held.value if lang != "zh"], WORDS, words_of), Index([(i, t) for i, lang, t in held.value if lang == "zh"], CHARACTERS, characters_of)))
    return _built["pair"]


def leaks(documents: DataFrame, items: DataFrame, exact: bool = True) -> DataFrame:
    """(doc_id, item_id), distinct. exact: only runs of equal words; else windows of shingle similarity 0.8 or more too."""
    spark = documents.sparkSession
    items = items.select("item_id", "lang", "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total * BYTES_PER_CHARACTER / ITEM_BLOCK_BYTES))
    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("item_id", T.LongType())])
    source = spread(documents.select("doc_id", "text").where(F.col("text").isNotNull()))
    parts = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).distinct().collect()
        held = spark.sparkContext.broadcast([(r[0], r[1], folded(r[2])) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], held=held, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            by_words, by_chars = _indexes(key, held)
            vectors, others = Vectors(), Vectors()
            for batch in in_slices(batches):
                ids, texts = batch.column(0).to_pylist(), [folded(t) for t in batch.column(1).to_pylist()]
                one = _matches([words_of(t) for t in texts], by_words, vectors, exact)
                # a text without ideographs is not asked for items of which each window must share some
                plain = by_chars.wide_shingles > 0
                two = _matches([[] if plain and not _CJK.search(t) else characters_of(t) for t in texts], by_chars, others, exact)
                pairs = [(d, i) for d, x, y in zip(ids, one, two, strict=True) for i in sorted(x | y)]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], batch.column(0).type), pa.array([p[1] for p in pairs], pa.int64())], names=["doc_id", "item_id"])

        parts.append(source.mapInArrow(run, schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p7_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks by shingle similarity, so with small changes inside the window, per document."""
    found = leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"), exact=False)
    return found.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"))


QUERIES = {"p7_found": p7_found, "p7_similar": p7_similar}


def _sql() -> str:
    """All windows of all texts joined on equality, for the small tables of the check."""
    fold = sql.folded(checks.same("text"))
    han = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{30ff}"
    words = rf"[{han}]|(?:\p{{N}}|[^\P{{L}}{han}])+"
    return rf"""WITH i AS (SELECT DISTINCT item_id AS id, lang, {fold} AS f FROM eval_items WHERE text IS NOT NULL), d AS (SELECT doc_id AS id, {fold} AS f FROM documents WHERE text IS NOT NULL),
        iw AS (SELECT id, regexp_extract_all(f, '{words}') AS w FROM i WHERE lang IS DISTINCT FROM 'zh'), dw AS (SELECT id, regexp_extract_all(f, '{words}') AS w FROM d),
        ic AS (SELECT id, array_to_string(regexp_extract_all(f, '[\p{{L}}\p{{N}}]'), '') AS s FROM i WHERE lang = 'zh'), dc AS (SELECT id, array_to_string(regexp_extract_all(f, '[\p{{L}}\p{{N}}]'), '') AS s FROM d),
        a AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - {WORDS - 2}), lambda k: array_to_string(w[k : k + {WORDS - 1}], ' '))) AS k FROM iw), b AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - {WORDS - 2}), lambda k: array_to_string(w[k : k + {WORDS - 1}], ' '))) AS k FROM dw),
        x AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(s) - {CHARACTERS - 2}), lambda k: substr(s, k, {CHARACTERS}))) AS k FROM ic), y AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(s) - {CHARACTERS - 2}), lambda k: substr(s, k, {CHARACTERS}))) AS k FROM dc)
        SELECT DISTINCT b.id AS doc_id, a.id AS item_id FROM a JOIN b USING (k) UNION SELECT DISTINCT y.id, x.id FROM x JOIN y USING (k)"""


ORACLE = {"p7_found": _sql()}

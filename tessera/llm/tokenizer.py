"""Problem 6: exact byte-level BPE ids by backtracking over longest matches.

A text is cut by the tokenizer's pattern; each piece is encoded without replaying the
merges. An Aho-Corasick automaton gives the longest token at every byte; the encoder
takes it if the pair (previous token, token) can stand side by side after all merges,
else it tries the next shorter prefix token, else it backs up one token. Compatible
pairs are exactly those the merges would leave, so the result equals the merge loop.

Defined cases: null and empty text give an empty list; strings of special tokens are
ordinary text; other columns of the input are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.llm.chunks import in_slices
from tessera.plans.runtime import read_table, spread

VOCABULARY_DIR = "/opt/tokenizers"
#: Fixed value: the public pattern that cuts text before byte-level merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces up to this many characters are remembered per worker; the memory is emptied when full.
REMEMBERED_CHARS, REMEMBERED_PIECES = 48, 200_000
_NONE = 1 << 30
_BUILT: dict[int, Encoder] = {}


class Encoder:
    """Tables of one vocabulary: automaton, next shorter prefix, merge halves, pair compatibility."""

    def __init__(self, rank_file: bytes):
        import ahocorasick
        import regex

        self.cut = regex.compile(PIECES).findall
        rank = {}
        for line in rank_file.split(b"\n"):
            if line:
                token, number = line.split()
                rank[base64.b64decode(token)] = int(number)
        self.tokens = [b""] * (max(rank.values()) + 1)
        for token, number in rank.items():
            self.tokens[number] = token
        self.length = [len(t) for t in self.tokens]
        self.shorter = [-1] * len(self.tokens)
        self.left = list(range(len(self.tokens)))
        self.right = list(range(len(self.tokens)))
        self.merged: dict[tuple[int, int], int] = {}
        missing = [b for b in range(256) if bytes([b]) not in rank]
        if missing:
            raise ValueError(f"no token for the single bytes {missing[:5]}; such a vocabulary cannot encode every text")
        self.single = [rank[bytes([b])] for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for number in sorted(rank.values()):
            token = self.tokens[number]
            self.automaton.add_word(token.decode("latin-1"), number)
            for end in range(len(token) - 1, 0, -1):
                if (prefix := rank.get(token[:end])) is not None:
                    self.shorter[number] = prefix
                    break
            if len(token) > 1:
                first, second = self._halves(token, number, rank)
                self.left[number], self.right[number] = first, second
                self.merged.setdefault((first, second), number)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.seen: dict[str, list[int]] = {}

    @staticmethod
    def _halves(token: bytes, number: int, rank: dict[bytes, int]) -> tuple[int, int]:
        """The two tokens whose merge made this one: its bytes merged by all earlier ranks."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, where = _NONE, -1
            for i in range(len(parts) - 1):
                if (r := rank.get(parts[i] + parts[i + 1], _NONE)) < best:
                    best, where = r, i
            if where < 0 or best >= number:
                raise ValueError(f"token {number} cannot be made by earlier merges")
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return rank[parts[0]], rank[parts[1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge of lower rank would have joined bytes across the border of a and b."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            known = self.fits[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        left, right, merged = self.left, self.right, self.merged
        limit = _NONE
        while True:
            if merged.get((a, b), _NONE) < limit:
                return False
            if a > b:  # undo the younger of the two: its inner merge happened after the other stood
                limit, a = a, right[a]
                if a == limit:  # a single byte has no halves
                    limit, b0 = b + 1, b
                    b = left[b]
                    if b == b0:
                        return True
            else:
                limit, b0 = b + 1, b
                b = left[b]
                if b == b0:
                    limit, a0 = a, a
                    a = right[a]
                    if a == a0:
                        return True

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        n = len(data)
        if n == 1:
            return [self.single[data[0]]]
        longest = [-1] * n
        length = self.length
        for end, number in self.automaton.iter(data.decode("latin-1")):
            start = end - length[number] + 1
            if longest[start] < 0 or length[longest[start]] < length[number]:
                longest[start] = number
        if length[longest[0]] == n:
            return [longest[0]]
        shorter, compatible = self.shorter, self.compatible
        dead = bytearray(n + 1)  # positions from which no encoding continues
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + length[token]
            if not dead[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                # the popped token now fails on its dead end and is shortened in the next round
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        seen = self.seen
        for piece in self.cut(text):
            ids = seen.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= REMEMBERED_CHARS:
                    if len(seen) >= REMEMBERED_PIECES:
                        seen.clear()
                    seen[piece] = ids
            out += ids
        return out

    def decode_table(self) -> tuple[np.ndarray, np.ndarray]:
        """All token bytes in one array, and where each id's bytes start (one more at the end)."""
        return np.frombuffer(b"".join(self.tokens), dtype=np.uint8), np.concatenate([[0], np.cumsum(self.length)])


def encoder_of(rank_file: bytes) -> Encoder:
    key = hash(rank_file)
    if key not in _BUILT:
        _BUILT[key] = Encoder(rank_file)
    return _BUILT[key]


def rank_bytes(name: str, folder: str = VOCABULARY_DIR) -> bytes:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARY_DIR) -> DataFrame:
    """(id, ids) of every row, one Arrow pass without a shuffle; only the rank file (under 1 MB) is broadcast."""
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(rank_bytes(vocabulary, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(ranks.value).encode
        for batch in in_slices(batches, 250):
            lists = [encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, "ids"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(df.select(id_col, text_col)).mapInArrow(run, schema)


def decode_corpus(ids: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARY_DIR) -> DataFrame:
    """(id, text): bytes gathered by an offset table; a null or empty list gives an empty text."""
    spark = ids.sparkSession
    ranks = spark.sparkContext.broadcast(rank_bytes(vocabulary, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, start = encoder_of(ranks.value).decode_table()
        for batch in in_slices(batches, 250):
            texts = []
            for row in batch.column(1).to_pylist():
                if not row:
                    texts.append("")
                    continue
                row = np.asarray(row)
                sizes = start[row + 1] - start[row]
                ends = np.cumsum(sizes)
                texts.append(data[np.repeat(start[row] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    schema = T.StructType([T.StructField(id_col, ids.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return ids.select(id_col, ids_col).mapInArrow(run, schema)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(read_table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact round trip: encode all documents, decode the ids."""
    return decode_corpus(p6_ids(spark, sf_dir))


QUERIES = {"p6_ids": p6_ids, "p6_decoded": p6_decoded}
ORACLE = {"p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}

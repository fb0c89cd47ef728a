import random

import pytest

from tessera.llm import splitting as P
from tessera.operators.structure import _tokens


@pytest.mark.parametrize("text", ["字" * 3000, "ก" * 5000, "word " * 2500, "a" * 60000 + " b" * 1500, "\n" * 9 + "x. y\n" * 900, "The board shall, at all times, keep records. " * 400, "é" * 3000])
def test_pieces(text):
    spans = P.split_spans(text)
    assert len(spans) > 1
    end = 0
    for a, b in spans:
        assert a <= end <= b and _tokens(text[a:b]) <= P.MAXIMUM
        assert end == 0 or _tokens(text[a:end] or "x") <= P.OVERLAP
        end = b
    assert end == len(text)


def test_sizes_equal_the_estimate():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["don't", "字", " ", "-", "’", "a1", "。", "　", "é", "😀", "\n"]) for _ in range(60))
        s = P.Spans(text)
        cuts = [i for i in range(len(text) + 1) if s.level[i] != 9]
        a, b = sorted(rng.sample(cuts, 2))
        assert s.tokens(a, b) == _tokens(text[a:b])


def test_best_of_all_cuts():
    """The cost found equals the least over all ways to cut, for a small text."""
    text = "Aa bb. Cc dd; ee ff.\nGg hh, ii jj. Kk ll." * 2
    target, most = 12, 18
    s = P.Spans(text)
    cuts = list(P._cuts(s, most / 4))
    cost = lambda a, b: P.PENALTIES[min(s.level[b], 4)] + 10 * ((s.tokens(a, b) - target) / target) ** 2 if s.tokens(a, b) <= most else float("inf")
    best = {0: 0.0}
    for j in range(1, len(cuts)):
        best[j] = min(best[i] + cost(cuts[i], cuts[j]) for i in range(j))
    found = P.split_spans(text, target, most, 0)
    assert sum(cost(a, b) for a, b in found) == pytest.approx(best[len(cuts) - 1])


def test_table(spark):
    rows = [("a", None), ("b", ""), ("c", " "), ("d", "short"), ("e", "long text. " * 400), ("e2", "long text. " * 400)]
    df = spark.createDataFrame(rows, "chunk_id string, text string").withColumn("split_part", P.F.lit("clash"))
    got = {}
    for r in P.split_all(df).collect():
        got.setdefault(r.chunk_id, []).append(r)
    assert set(got) == {"b", "c", "d", "e", "e2"} and [len(got[k]) for k in "bcd"] == [1, 1, 1]
    parts = sorted(got["e"], key=lambda r: r.split_part)
    assert [p.split_part for p in parts] == list(range(1, len(parts) + 1)) and all(p.n_parts == len(parts) for p in parts)
    assert P.split_all(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.split_oversized(df, 700, 650, 70)

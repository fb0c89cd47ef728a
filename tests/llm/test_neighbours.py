import numpy as np
import pytest

from tessera.llm import neighbours as N


def brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    return {i: sorted(((-round(float(s[r, c]), 6), ids[c]) for c in range(len(ids)) if c != r))[:k] for r, i in enumerate(ids)}


def table(spark, ids, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "id string, vec array<double>")


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4200, 16))
    x[:1400] = x[0] + 0.02 * rng.standard_normal((1400, 16))  # a third of all rows close together
    return [f"v{i:05d}" for i in range(len(x))], x.astype(np.float32)


def test_recall_in_several_partitions(spark, cloud, monkeypatch):
    monkeypatch.setattr(N, "ROWS", 300)
    monkeypatch.setattr(N, "INDEX_BLOCK", 128)
    monkeypatch.setattr(N, "QUERY_BLOCK", 256)
    ids, x = cloud
    want = brute(ids, x.astype(float), 5)
    got = {}
    for r in N.most_similar(table(spark, ids, x), 16, k=5, probes=6).collect():
        got.setdefault(r.id, []).append(r.other)
    assert all(len(got[i]) == 5 for i in ids)
    recall = np.mean([len({o for _, o in want[i]} & set(got[i])) / 5 for i in ids])
    assert recall >= 0.9


def test_small_table_is_exact_with_ties_and_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (60, 4)).astype(float)
    x[(x == 0).all(axis=1)] = 1
    ids = [f"i{k:02d}" for k in range(60)]
    got = {}
    for r in N.most_similar(table(spark, ids, x), 4, k=3).collect():
        got.setdefault(r.id, []).append((-round(r.similarity, 6), r.other))
    want = brute(ids, x, 3)
    assert all([s for s, _ in sorted(got[i])] == [s for s, _ in want[i]] for i in ids)
    exact = [i for i in ids if len({s for s, _ in brute(ids, x, 4)[i]}) == 4]  # no ties at the border
    assert all(sorted(got[i]) == want[i] for i in exact)


def test_many_copies(spark):
    x = np.vstack([np.tile([1.0, 0, 0], (40, 1)), [[0.99, 0.1, 0], [0, 1, 0]]])
    ids = [f"c{k:02d}" for k in range(42)]
    rows = N.most_similar(table(spark, ids, x), 3, k=5, least=0.95).collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, set()).add(r.other)
    assert got["c39"] == {"c00", "c01", "c02", "c03", "c04"} and got["c00"] == {"c01", "c02", "c03", "c04", "c05"}
    assert got["c40"] == {"c00", "c01", "c02", "c03", "c04"} and "c41" not in got


def test_unusable_rows(spark):
    rows = [("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0]), ("e", [float("nan"), 1.0]), ("f", [None, 1.0]), (None, [1.0, 0.0]), ("g", [2.0, 0.1]), ("h", [])]
    df = spark.createDataFrame(rows, "id string, vec array<double>")
    got = sorted((r.id, r.other) for r in N.most_similar(df, 2).collect())
    assert got == [("a", "g"), ("g", "a")]
    assert N.most_similar(df.limit(0), 2).count() == 0


def test_query_condition_with_copies(spark):
    x = [[1.0, 0.0], [1.0, 0.0], [0.9, 0.2], [0.0, 1.0], [0.1, 1.0]]
    got = {}
    for r in N.most_similar(table(spark, ["a", "b", "c", "d", "e"], x), 2, k=2, query=lambda c: c.isin("b", "d")).collect():
        got.setdefault(r.id, set()).add(r.other)
    assert got == {"b": {"a", "c"}, "d": {"e", "c"}}


def test_two_levels(spark, monkeypatch):
    """Far more partitions than one classifier tells apart: cells first, then partitions inside the cells, in one pass and in several."""
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((150, 16))
    x = (centres[rng.integers(0, 150, 3000)] + 0.5 * rng.standard_normal((3000, 16))).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (u @ u.T).astype(float)
    np.fill_diagonal(s, -9)
    df = spark.createDataFrame([(f"v{i:04d}", [float(e) for e in r]) for i, r in enumerate(x)], "id string, vec array<float>")
    monkeypatch.setattr(N, "ROWS", 60)
    monkeypatch.setattr(N, "FAN_OUT", 8)
    for size in (N.ROUTER_BYTES, 2000):
        monkeypatch.setattr(N, "ROUTER_BYTES", size)
        got = {}
        for r in N.most_similar(df, 16, k=5, probes=8).collect():
            got.setdefault(int(r.id[1:]), set()).add(int(r.other[1:]))
        assert len(got) == 3000 and all(len(v) == 5 for v in got.values())
        want = np.argsort(-s, axis=1)[:, :5]
        assert np.mean([len(got[i] & set(want[i])) / 5 for i in range(3000)]) > 0.9

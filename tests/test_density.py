import numpy as np

from tessera.operators import assign, density
from tessera.plans import induce


def corpus(spark, n, topics, small, dims=60, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((topics, dims)) * 3
    owner = np.where(np.arange(n) < small, topics - 1, rng.integers(0, topics - 1, n))
    x = centre[owner] + rng.standard_normal((n, dims))
    x[-n // 20 :] = rng.standard_normal((len(x[-n // 20 :]), dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True), owner


def test_blocks_equal_to_one_matrix(spark):
    x, _ = corpus(spark, 700, 6, 12)
    ids = [f"c{i:04d}" for i in range(len(x))]
    label, strength, _ = assign.cluster_points(x)
    rows = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in zip(ids, x, strict=True)], "chunk_id string, embedding array<double>")
    for block in (90, 1000):
        got, found, noise = density.clusters(rows, "chunk_id", "embedding", len(x), block=block)
        got = {r[0]: r[1:] for r in got.collect()}
        assert (found, noise) == (label.max() + 1, (label < 0).sum()) and found >= 6
        mine = np.array([got.get(i, (-1, 0.0))[0] for i in ids])
        name = {int(g): int(np.bincount(mine[label == g]).argmax()) for g in range(label.max() + 1)}
        assert len(set(name.values())) == found
        # a row equally near to two clusters may go to either
        assert (mine == [name.get(int(g), -1) for g in label]).mean() >= 0.995
        assert np.mean([abs(strength[k] - got.get(i, (-1, 0.0))[1]) < 1e-9 for k, i in enumerate(ids)]) >= 0.995


def test_every_chunk_is_clustered(spark):
    """A topic of 12 in 6,000 chunks (0.2 %) is a cluster, and its id is the hash of all its core members."""
    x, owner = corpus(spark, assign.EXACT_POINTS + 1000, 4, 12, dims=8)
    rows = spark.createDataFrame([(f"c{i:05d}", [float(z) for z in v]) for i, v in enumerate(x)], "chunk_id string, embedding array<double>")
    core, method, noise = induce.core_members(rows, len(x))
    core = core.collect()
    assert method == "hdbscan" and len(core) + noise == len(x)
    small = [{r[0] for r in core if r[1] == g} for g in {r[1] for r in core}]
    assert any(len(s) >= 10 and all(int(i[1:]) < 12 for i in s) for s in small)


def test_linkage_without_a_matrix():
    x = np.random.default_rng(1).standard_normal((120, 5))
    for k in (2, 7, 120):
        assert (assign.chained_linkage(x, k) == assign.average_linkage(x, k)).all()

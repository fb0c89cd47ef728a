"""Problem 5: topic clusters with their size and most typical members.

Each partition of the rows builds trees of mergeable cluster features (count, sum, sum of
squares); a full tree hands its leaf entries on and starts again, so no entry is left out or
widened, however many there are. The entries of all partitions are merged in one tree; where
they are too many for one, those that lie around the same pivot are merged, each time around
other pivots. Ward agglomeration runs over the entries that may begin a topic; the levels are cut where the next merge costs many times the last one and the leaf concepts
fall into most clusters. Then one pass compares every row with every centroid; rows below
the valley of the similarities to their nearest centroid are left over. Members nearest to
their centroid describe the cluster.

The cost of a merge grows with the rows, so the level that parts small topics may cut a large
one in two. Clusters with many rows on the border between them are parts of one topic and are joined
before concepts are given to clusters.

The same rule holds at every size: an entry begins a topic if it holds LEAST rows, or takes
in a concept that no such entry takes in (a topic of few rows with its concept). The rows of
other entries are left over by the first assignment if no topic is near, and the rows left
over are clustered again, by themselves, until no sound topic of LEAST rows is among them
(ROUNDS times at most). What is left then are strays.

Where several leaf concepts fall into one cluster, the cluster is split between them: each
member goes to the nearest of the cluster's concepts.

Defined cases: null, all-zero, non-finite and odd-length vectors and those of other models
take no part; a repeated chunk counts once; no rows give no clusters; a cluster in which no
concept falls has none; where no entry holds LEAST rows, the largest begin topics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.neighbours import chunk_vectors, usable
from tessera.plans.runtime import cut_lineage, read_table

#: Leaf entries under one inner node, and leaf entries of a tree that is handed on and of those merged at once.
BRANCHING, MOST_LEAVES = 64, 20_000
#: Mean squared distance between the members of a leaf entry (unit vectors: 2 - 2 * mean cosine).
DIAMETER = 1.0
#: Times that entries meet around other pivots at least, and the share that is left of them where another time is not worth it.
MEETINGS, SHRUNK = 4, 0.98
#: Rows an entry holds at least to begin a topic, if no concept speaks for it.
LEAST = 8
#: Rounds at most (each takes the rows left over by the last).
ROUNDS = 8
#: Width of the border between two clusters (difference of a row's similarities to both), and the share of the smaller one's rows in it from which both are one topic.
BORDER, SHARED = 0.1, 0.1
#: Rows compared with all entries at once.
AT_ONCE = 2048
TYPICAL = 3
SUMMARY = "n double, total array<double>, squares double"


class Tree:
    """Cluster features in leaf entries under inner nodes of bounded fan-out.

    An entry takes in a point (or another entry) if its mean squared diameter stays within
    the threshold. A full tree hands its entries on and starts again.
    """

    def __init__(self, dimensions: int, most: int = MOST_LEAVES, threshold: float = DIAMETER):
        self.dim, self.most, self.threshold = dimensions, most, threshold
        self.left_n, self.left_total = 0.0, np.zeros(dimensions)  # of the entries handed on
        self.handed: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._clear()

    def _clear(self) -> None:
        self.count = 0
        self.n, self.squares = np.zeros(self.most), np.zeros(self.most)
        self.total, self.centre = np.zeros((self.most, self.dim)), np.zeros((self.most, self.dim))
        self.of = np.zeros(self.most, np.int64)  # the inner node of an entry
        self.nodes: list[list[int]] = [[]]
        self.node_n = np.zeros(self.most + 1)
        self.node_total, self.node_centre = np.zeros((self.most + 1, self.dim)), np.zeros((self.most + 1, self.dim))

    def insert(self, n: float, total: np.ndarray, squares: float) -> None:
        centre = total / n
        node = 0
        if len(self.nodes) > 1:
            d = self.node_centre[: len(self.nodes)] - centre
            node = int(np.einsum("ij,ij->i", d, d).argmin())
        members = self.nodes[node]
        if members:
            d = self.centre[members] - centre
            near = members[int(np.einsum("ij,ij->i", d, d).argmin())]
            m, t, q = self.n[near] + n, self.total[near] + total, self.squares[near] + squares
            if 2 * (m * q - t @ t) <= self.threshold * m * (m - 1):
                self.n[near], self.total[near], self.squares[near], self.centre[near] = m, t, q, t / m
                self._grow(node, n, total)
                return
        if self.count == self.most:
            self._hand_on()
            self.insert(n, total, squares)
            return
        k = self.count
        self.count += 1
        self.n[k], self.total[k], self.squares[k], self.centre[k] = n, total, squares, centre
        members.append(k)
        self.of[k] = node
        self._grow(node, n, total)
        if len(members) > BRANCHING:
            self._split(node)

    def insert_many(self, x: np.ndarray) -> None:
        """Points of weight 1: those near an entry are added to it together, the others one by one."""
        for low in range(0, len(x), AT_ONCE):
            part = x[low : low + AT_ONCE]
            left = np.ones(len(part), bool)
            if self.count:
                centre = self.centre[: self.count]
                near = ((centre**2).sum(axis=1)[None] - 2 * part @ centre.T).argmin(axis=1)
                m, t, q = self.n[near] + 1, self.total[near] + part, self.squares[near] + 1.0
                fits = 2 * (m * q - np.einsum("ij,ij->i", t, t)) <= self.threshold * m * (m - 1)
                for k in np.unique(near[fits]):
                    rows = np.flatnonzero(fits & (near == k))
                    m, t, q = self.n[k] + len(rows), self.total[k] + part[rows].sum(axis=0), self.squares[k] + len(rows)
                    if 2 * (m * q - t @ t) <= self.threshold * m * (m - 1):
                        self.n[k], self.total[k], self.squares[k], self.centre[k] = m, t, q, t / m
                        self._grow(int(self.of[k]), len(rows), part[rows].sum(axis=0))
                        left[rows] = False
            for v in part[left]:
                self.insert(1.0, v, 1.0)

    def _grow(self, node: int, n: float, total: np.ndarray) -> None:
        self.node_n[node] += n
        self.node_total[node] += total
        self.node_centre[node] = self.node_total[node] / self.node_n[node]

    def _split(self, node: int) -> None:
        rows = np.array(self.nodes[node])
        c = self.centre[rows]
        d = ((c[:, None] - c[None]) ** 2).sum(axis=2)
        a, b = np.unravel_index(d.argmax(), d.shape)
        far = d[:, b] < d[:, a]
        self.nodes.append([])
        for where, part in ((node, rows[~far]), (len(self.nodes) - 1, rows[far])):
            self.nodes[where] = part.tolist()
            self.of[part] = where
            self.node_n[where], self.node_total[where] = self.n[part].sum(), self.total[part].sum(axis=0)
            self.node_centre[where] = self.node_total[where] / max(self.node_n[where], 1)

    def _hand_on(self) -> None:
        self.handed.append(self.leaves())
        self.left_n += self.n[: self.count].sum()
        self.left_total += self.total[: self.count].sum(axis=0)
        self._clear()

    def leaves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n, sums and sums of squares of the entries."""
        return self.n[: self.count], self.total[: self.count], self.squares[: self.count]

    def takes_in(self, n: np.ndarray, total: np.ndarray, squares: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Whether each of the given unit vectors lies as near to the rows of each entry, in the mean, as these may to each other (however many they are)."""
        return (squares / n)[:, None] - 2 * (total / n[:, None]) @ given.T + 1 <= self.threshold


def ward(n: np.ndarray, total: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (kept, absorbed, cost) in order of cost, the growth of the within-cluster sum of squares.

    Clusters nearest to each other are merged wherever a chain of nearest ones ends, which gives the same tree as taking
    the cheapest pair each time, without a matrix of all pairs.
    """
    size, centre = n.astype(float).copy(), total / n[:, None]
    length, gone = (centre**2).sum(axis=1), np.zeros(len(n))
    merges: list[tuple[float, int, int, int]] = []
    chain: list[int] = []
    start = 0
    while len(merges) < len(n) - 1:
        if not chain:
            while gone[start]:
                start += 1
            chain.append(start)
        a = chain[-1]
        cost = np.maximum(length + length[a] - 2 * centre @ centre[a], 0) * (size * size[a] / (size + size[a])) + gone
        cost[a] = np.inf
        b = int(cost.argmin())
        if len(chain) > 1 and cost[chain[-2]] <= cost[b]:
            b = chain[-2]
            price, chain = float(cost[b]), chain[:-2]
            a, b = min(a, b), max(a, b)
            merges.append((price, len(merges), a, b))
            centre[a] = (size[a] * centre[a] + size[b] * centre[b]) / (size[a] + size[b])
            size[a] += size[b]
            length[a] = centre[a] @ centre[a]
            gone[b] = np.inf
        else:
            chain.append(b)
    return [(a, b, h) for h, _, a, b in sorted(merges)]


def _labels(count: int, merges: list[tuple[int, int, float]], clusters: int) -> np.ndarray:
    up = np.arange(count)
    for a, b, _ in merges[: count - clusters]:
        up[b] = a
    while (up[up] != up).any():
        up = up[up]
    return np.unique(up, return_inverse=True)[1]


def cut_levels(n: np.ndarray, total: np.ndarray, squares: np.ndarray, concepts: np.ndarray) -> np.ndarray:
    """Unit centroids of the clusters. Of the levels whose next merge costs at least 1.3 times the last one, those whose
    clusters hold most concepts are kept, and of these the one with the steepest step. Without concepts the step alone decides.
    The entries as they are count as a level too: the last merge inside an entry costs about the sum of squares along two axes."""
    merges = ward(n, total)
    inside = np.maximum(squares - (total**2).sum(axis=1) / n, 0) * 2 / total.shape[1]
    heights = np.maximum.accumulate([float(np.quantile(inside, 0.9)), *(h for *_, h in merges)])
    best, out = (-1, 0.0), total.sum(axis=0, keepdims=True)
    for i in range(len(merges)):
        clusters, step = len(n) - i, heights[i + 1] / max(heights[i], 1e-12)
        if step < 1.3:
            continue
        label = _labels(len(n), merges, clusters)
        sums = np.zeros((clusters, total.shape[1]))
        np.add.at(sums, label, total)
        unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        held = len(np.unique((concepts @ unit.T).argmax(axis=1))) if len(concepts) else 0
        if (held, step) > best:
            best, out = (held, step), unit
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _summary(n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, total.shape[1], dtype=np.int32)), pa.array(total.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(n), lists, pa.array(squares)], names=["n", "total", "squares"])


def _entries(table: pa.RecordBatch | pa.Table, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    total = table.column("total")
    total = total.combine_chunks() if isinstance(total, pa.ChunkedArray) else total
    return table.column("n").to_numpy(), total.flatten().to_numpy().reshape(-1, dimensions), table.column("squares").to_numpy()


def _merged(entries: DataFrame, dimensions: int, pivots: np.ndarray | None = None) -> DataFrame:
    """The entries nearest to each pivot in one tree; without pivots all of them."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = (_entries(batch, dimensions)[1] @ pivots.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["n", "total", "squares", "cell"])

    def merge(table: pa.Table) -> pa.Table:
        n, total, squares = _entries(table, dimensions)
        tree = Tree(dimensions, len(n))
        for k in np.argsort(-n, kind="stable"):
            tree.insert(n[k], total[k], squares[k])
        return pa.Table.from_batches([_summary(*tree.leaves())])

    placed = entries.withColumn("cell", F.lit(0)) if pivots is None else entries.mapInArrow(near, f"{SUMMARY}, cell long")
    return cut_lineage(placed.groupBy("cell").applyInArrow(merge, SUMMARY))


def summarise(rows: DataFrame, dimensions: int, given: np.ndarray, later: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, sums and sums of squares of the entries over all rows that may begin a topic; only these reach the driver. given: unit vectors of concepts."""
    most = MOST_LEAVES

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(dimensions, most)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(float)
                tree.insert_many(x / np.linalg.norm(x, axis=1, keepdims=True))
            while tree.handed:
                yield _summary(*tree.handed.pop())
        if tree.count:
            yield _summary(*tree.leaves())

    entries = cut_lineage(rows.select("vec").mapInArrow(grow, SUMMARY))
    count, before, met = entries.count(), 0, 0
    while count > most and (met < MEETINGS or count < SHRUNK * before):
        chosen = entries.orderBy(F.xxhash64("total", F.lit(met))).limit(-(-2 * count // most)).select("total").collect()
        pivots = np.array([r[0] for r in chosen])
        entries = _merged(entries, dimensions, pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-12))
        count, before, met = entries.count(), count, met + 1
    if count <= most:
        entries = _merged(entries, dimensions)
    few = LEAST if later else min(LEAST, entries.agg(F.max("n")).first()[0] or LEAST)
    thick = entries.where(F.col("n") >= few)
    if count > most:  # what met around different pivots
        thick = _merged(thick, dimensions)

    def collected(entries: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held = entries.orderBy(F.desc("n"), "total").collect()
        return np.array([r[0] for r in held]), np.array([r[1] for r in held]).reshape(-1, dimensions), np.array([r[2] for r in held])

    found = collected(thick)
    alone = given if not len(found[0]) else given[~Tree(dimensions, 1).takes_in(*found, given).any(axis=0)]
    if not len(alone):
        return found

    def spoken_for(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(Tree(dimensions, 1).takes_in(*_entries(batch, dimensions), alone).any(axis=1)))

    return tuple(np.concatenate(pair) for pair in zip(found, collected(entries.where(F.col("n") < few).mapInArrow(spoken_for, SUMMARY)), strict=True))


def valley(counts: dict[int, int], bins: int = 50) -> float:
    """Similarity below which a row resembles no cluster: the thinnest place between the strays and the members."""
    h = np.zeros(bins + 1)
    for k, n in counts.items():
        h[min(max(k, 0), bins)] += n
    smooth = np.convolve(h, [0.25, 0.5, 0.25], mode="same")
    main = int(smooth.argmax())
    low = int(smooth[: max(main - bins // 5, 1)].argmax())
    between = smooth[low : main + 1]
    return (low + int(np.flatnonzero(between == between.min())[-1])) / bins


def _assigned(rows: DataFrame, centres: np.ndarray, first: int) -> DataFrame:
    """(id, vec, cluster, similarity, second, margin): the nearest centroid of each row, numbered from first, the next one and how much less similar it is."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, centres.shape[1]).astype(float)
            x = x / np.linalg.norm(x, axis=1)[:, None]
            (best, second), (score, next_score) = np.zeros((2, len(x)), np.int64), np.zeros((2, len(x)))
            for low in range(0, len(x), AT_ONCE):
                s, here = x[low : low + AT_ONCE] @ centres.T, slice(low, low + AT_ONCE)
                best[here], score[here] = s.argmax(axis=1), s.max(axis=1)
                s[np.arange(len(s)), best[here]] = -np.inf
                second[here], next_score[here] = s.argmax(axis=1), s.max(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array((best + first).astype(np.int32)), pa.array(score), pa.array((second + first).astype(np.int32)), pa.array(score - next_score)],
                names=["id", "vec", "cluster", "similarity", "second", "margin"],
            )

    return cut_lineage(rows.select("id", "vec").mapInArrow(run, "id string, vec array<float>, cluster int, similarity double, second int, margin double"))


def _parts(assigned: DataFrame, least: float, held: dict[int, int]) -> list[tuple[int, int]]:
    """Pairs of clusters that are parts of one topic: SHARED of the rows of the smaller one, and LEAST of them, lie about as near to both. held: rows of each cluster."""
    near = assigned.where((F.col("similarity") >= least) & (F.col("margin") < BORDER / 2))
    between = near.groupBy(F.least("cluster", "second").alias("one"), F.greatest("cluster", "second").alias("other")).count().where(F.col("count") >= LEAST)
    return [(r[0], r[1]) for r in between.collect() if r[2] >= SHARED * min(held.get(r[0], 0), held.get(r[1], 0))]


def _joined(centres: np.ndarray, pairs: list[tuple[int, int]], weight: dict[int, float]) -> np.ndarray:
    """Unit centroids where those of each pair are one. weight: sum of the similarities of a cluster's rows, the length of the sum of their vectors."""
    up = list(range(len(centres)))

    def top(k: int) -> int:
        while up[k] != k:
            k = up[k]
        return k

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    roots = np.array([top(k) for k in range(len(centres))])
    sums = np.zeros_like(centres)
    np.add.at(sums, roots, centres * np.array([max(weight.get(k, 0.0), 1e-9) for k in range(len(centres))])[:, None])
    sums = sums[np.unique(roots)]
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)


def _named(members: DataFrame, given: np.ndarray, owners: dict[int, list[int]], names: list[str]) -> DataFrame:
    """(id, cluster, similarity, concept_id): the nearest of the concepts of each row's cluster."""
    sent = members.sparkSession.sparkContext.broadcast((given, owners, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, owners, names = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, given.shape[1]).astype(float)
            cluster, concept = batch.column(2).to_numpy(), np.full(len(x), -1)
            for k in np.unique(cluster):
                if mine := owners.get(int(k)):
                    who = np.flatnonzero(cluster == k)
                    concept[who] = np.array(mine)[(x[who] @ given[mine].T).argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([names[c] if c >= 0 else None for c in concept], pa.string())], names=["id", "cluster", "similarity", "concept_id"])

    return members.select("id", "vec", "cluster", "similarity").mapInArrow(run, "id string, cluster int, similarity double, concept_id string")


def cluster(rows: DataFrame, concepts: list[tuple[str, list[float]]], dimensions: int) -> DataFrame:
    """rows: id, vec. (id, cluster, similarity, concept_id) of every row that belongs to a cluster."""
    spark = rows.sparkSession
    once = Window.partitionBy("id").orderBy(F.xxhash64("vec"))
    left = cut_lineage(usable(rows, dimensions).withColumn("n", F.row_number().over(once)).where("n = 1").drop("n"))
    names = [name for name, _ in concepts]
    given = np.array([v for _, v in concepts], dtype=float).reshape(-1, dimensions)
    given /= np.maximum(np.linalg.norm(given, axis=1, keepdims=True), 1e-12)
    n, total, squares = summarise(left, dimensions, given)
    if not len(n):
        return spark.createDataFrame([], "id string, cluster int, similarity double, concept_id string")
    centres = cut_levels(n, total, squares, given)
    waiting, out, least, typical, first, known = list(range(len(names))), None, None, None, 0, np.zeros((0, dimensions))
    for _ in range(ROUNDS):
        while True:
            assigned = _assigned(left, centres, first)
            low = least if least is not None else valley({r[0]: r[1] for r in assigned.groupBy(F.floor(F.col("similarity") * 50).cast("int")).count().collect()})
            reached = F.col("similarity") >= low
            held = {r[0]: (r[1], r[2]) for r in assigned.where(reached).groupBy("cluster").agg(F.count("*"), F.avg("similarity")).collect()}
            pairs = _parts(assigned, low, {c: k for c, (k, _) in held.items()}) if len(centres) > 1 else []
            if not pairs:
                break
            centres = _joined(centres, [(a - first, b - first) for a, b in pairs], {c - first: k * m for c, (k, m) in held.items()})
        least, known = low, np.concatenate([known, centres])
        # a concept belongs to the cluster nearest to it; one that lies in none yet waits for a later round
        nearest = given @ centres.T
        owners: dict[int, list[int]] = {}
        placed = [c for c in waiting if nearest[c].max() >= least]
        for c in placed:
            owners.setdefault(int(nearest[c].argmax()) + first, []).append(c)
        if typical is None:
            typical = sum(k * m for k, m in held.values()) / max(sum(k for k, _ in held.values()), 1)
            taken = reached
        else:  # rows that lie together by chance are few or far from their middle
            sound = [c for c, (k, m) in held.items() if k >= LEAST and m >= (least + typical) / 2]
            if not sound:
                break
            taken = reached & F.col("cluster").isin(sound)
            placed = [c for k in sound for c in owners.get(k, [])]
        members = _named(assigned.where(taken), given, owners, names)
        out = members if out is None else out.unionByName(members)
        waiting, first = [c for c in waiting if c not in placed], first + len(centres)
        left = cut_lineage(assigned.where(~taken).select("id", "vec"))
        n, total, squares = summarise(left, dimensions, given[waiting], later=True)
        # an entry that lies in a cluster found before is the edge of it, no topic
        unit = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
        thick = ((unit @ known.T).max(axis=1, initial=-1.0) < least)
        if not thick.any():
            break
        centres = cut_levels(n[thick], total[thick], squares[thick], given[waiting]) if thick.sum() > 2 else unit[thick]
    return out


def _topics(spark: SparkSession, sf_dir: str, dimensions: int = 64) -> DataFrame:
    leaves = read_table(spark, sf_dir, "concepts").where("level = 2 AND embedding IS NOT NULL").select("concept_id", "embedding").distinct().orderBy("concept_id").collect()
    return cluster(chunk_vectors(spark, sf_dir), [(r[0], r[1]) for r in leaves if len(r[1]) == dimensions], dimensions)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topics(spark, sf_dir).where(F.col("concept_id").isNotNull()).select(F.col("id").alias("chunk_id"), "concept_id")


def p5_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each topic with its concept, size and most typical chunks."""
    members = cut_lineage(_topics(spark, sf_dir))
    order = Window.partitionBy("cluster").orderBy(F.desc("similarity"), "id")
    typical = members.withColumn("n", F.row_number().over(order)).where(F.col("n") <= TYPICAL)
    typical = typical.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda s: s["id"]).alias("typical"))
    sizes = members.groupBy("cluster", "concept_id").agg(F.count("*").alias("size"), F.round(F.avg("similarity"), 6).alias("mean_similarity"))
    return sizes.join(typical, "cluster")


QUERIES = {"p5_found": p5_found, "p5_topics": p5_topics}
ORACLE: dict[str, str] = {}

"""Vectors and clusters: assignments, representatives, small exact clusterings."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vector import centroids, own_similarity, similarities, usable

#: Points the driver clusters at most; density.clusters does the same to larger sets on the executors.
EXACT_POINTS = 5000
SECONDARY_LEAST, SECONDARY_GAP, MOST_CONCEPTS = 0.78, 0.035, 2


def embedding_text(text: Column, model: str, role: str = "passage") -> Column:
    """What is encoded: models of the e5 family want the role in front."""
    return F.concat(F.lit(f"{role}: "), text) if "e5" in model.lower() else text


def primary(df: DataFrame, key: str, vec: str, clusters: DataFrame, name: str, vector: str, label: str | None = None, probability: str | None = None) -> DataFrame:
    """(key, name, semantic_similarity, confidence): a labelled row keeps its label (half similarity, half probability);
    another gets the most similar cluster (0.8 of the similarity). Ties go to the lower name. Nothing is shuffled."""
    clip = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6).alias("confidence")
    s = F.round("similarity", 6).alias("semantic_similarity")
    free = df if label is None else df.where(F.col(label).isNull())
    nearest = similarities(free, key, vec, clusters, name, vector, top=1).select(key, name, s, clip(F.col("similarity") * 0.8))
    if label is None:
        return nearest
    strength = F.col(probability) if probability else F.lit(1.0)
    own = own_similarity(df.withColumn("_key", F.struct(F.col(key).alias("k"), strength.alias("p"))), "_key", vec, label, clusters, name, vector)
    own = own.select(F.col("_key")["k"].alias(key), F.col(label).alias(name), s, clip(F.col("similarity") * 0.5 + F.col("_key")["p"] * 0.5))
    return own.unionByName(nearest)


def secondary(df: DataFrame, key: str, vec: str, clusters: DataFrame, name: str, vector: str, chosen: DataFrame, least: float = SECONDARY_LEAST, gap: float = SECONDARY_GAP) -> DataFrame:
    """Further clusters of a row beside the chosen (key, name): similar enough, close to its most similar one, so many in all.

    The most similar MOST_CONCEPTS clusters hold all that can be taken, as one of them at most is the chosen one.
    """
    held = similarities(df, key, vec, clusters, name, vector, top=MOST_CONCEPTS).withColumn("_s", F.round("similarity", 6))
    near = held.withColumn("_top", F.max("_s").over(Window.partitionBy(key)))
    near = near.where((F.col("_s") >= least) & (F.round(F.col("_top") - F.col("_s"), 6) <= gap)).join(chosen.select(key, name), [key, name], "left_anti")
    order = Window.partitionBy(key).orderBy(F.desc("_s"), name)
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= MOST_CONCEPTS - 1).select(key, name, F.col("_s").alias("semantic_similarity"))


def representatives(df: DataFrame, key: str, vec: str, group: str, limit: int = 3) -> DataFrame:
    """(group, rank, key, similarity): members most similar to the centroid of their group, ties to the larger key."""
    members = df.where(usable(F.col(vec))).select(group, key, vec)
    centre = centroids(members, group, vec)
    scored = own_similarity(members, key, vec, group, centre, group, "centroid").withColumn("similarity", F.round("similarity", 6))
    order = Window.partitionBy(group).orderBy(F.desc("similarity"), F.desc(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def automatic_settings(n: int) -> tuple[int, int]:
    """Least cluster size and neighbourhood size for n points."""
    size = max(8, min(10, round(math.sqrt(n) / 3)))
    return size, max(2, round(size * 0.3))


def leading_axes(v: np.ndarray) -> np.ndarray:
    """The axes with their largest component positive."""
    return v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]


def reduce_dimensions(x: np.ndarray, most: int = 50) -> np.ndarray:
    """Centred principal components, rows of unit length; as they are where that would not make them fewer."""
    k = min(most, len(x) - 1, x.shape[1])
    if k < 2 or k >= x.shape[1]:
        return x
    y = x - x.mean(axis=0)
    _, _, v = np.linalg.svd(y, full_matrices=False)
    z = y @ leading_axes(v[:k]).T
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def average_linkage(x: np.ndarray, clusters: int) -> np.ndarray:
    """Agglomerative clusters by mean cosine distance; labels in order of first members."""
    n = len(x)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    d = 1.0 - u @ u.T
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    for _ in range(n - clusters):
        a, b = sorted(map(int, np.unravel_index(d.argmin(), d.shape)))
        merged = (d[a] * size[a] + d[b] * size[b]) / (size[a] + size[b])
        merged[[a, b]] = np.inf
        d[a] = d[:, a] = merged
        d[b] = d[:, b] = np.inf
        size[a] += size[b]
        label[label == b] = a
    first = {}
    return np.array([first.setdefault(v, len(first)) for v in label])


def chained_linkage(x: np.ndarray, clusters: int) -> np.ndarray:
    """average_linkage without a matrix of distances: the mean cosine of two clusters is that of their sums, and clusters
    nearest to each other are merged wherever a chain of nearest ones ends, which gives the same tree."""
    n = len(x)
    total = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    size, gone, merges, chain, start = np.ones(n), np.zeros(n), [], [], 0
    while len(merges) < n - 1:
        if not chain:
            while gone[start]:
                start += 1
            chain = [start]
        a = chain[-1]
        d = 1.0 - (total @ total[a]) / (size * size[a]) + gone
        d[a] = np.inf
        b = int(d.argmin())
        if len(chain) > 1 and d[chain[-2]] <= d[b]:
            b = chain[-2]
            chain = chain[:-2]
            merges.append((float(d[b]), len(merges), min(a, b), max(a, b)))
            a, b = merges[-1][2:]
            total[a] += total[b]
            size[a] += size[b]
            gone[b] = np.inf
        else:
            chain.append(b)
    up = list(range(n))
    for _, _, a, b in sorted(merges)[: n - clusters]:
        up[b] = a
    first: dict[int, int] = {}
    out = np.zeros(n, int)
    for i in range(n):  # a cluster keeps its first member as its name, so up[i] <= i is settled already
        up[i] = up[up[i]]
        out[i] = first.setdefault(up[i], len(first))
    return out


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette by cosine distance; a member of a cluster of one counts 0."""
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    d = 1.0 - u @ u.T
    np.fill_diagonal(d, 0.0)
    groups = np.unique(label)
    if len(groups) < 2:
        return 0.0
    member = (label[:, None] == groups[None]).astype(float)
    sums, sizes = d @ member, member.sum(axis=0)
    own = member.argmax(axis=1)
    at = np.arange(len(x))
    inside = sums[at, own] / np.maximum(sizes[own] - 1, 1)
    means = sums / sizes
    means[at, own] = np.inf
    outside = means.min(axis=1)
    s = np.where(sizes[own] > 1, (outside - inside) / np.maximum(np.maximum(inside, outside), 1e-12), 0.0)
    return float(s.mean())


def density_clusters(x: np.ndarray, least: int, neighbours: int) -> tuple[np.ndarray, np.ndarray]:
    """Hierarchical density clusters by excess of mass: (label or -1, strength of membership).

    Mutual reachability, its minimum spanning tree, the tree of clusters of at least `least` points, and the set of
    clusters that lose least when points leave; never the whole as one cluster.
    """
    n = len(x)
    if n > EXACT_POINTS:
        raise ValueError(f"at most {EXACT_POINTS} points; density.clusters takes larger sets")
    if n < 2:
        return np.full(n, -1), np.zeros(n)
    sq = (x**2).sum(axis=1)
    d = np.sqrt(np.maximum(sq[:, None] + sq[None] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0.0)
    core = np.sort(d, axis=1)[:, min(neighbours, n) - 1]
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)
    # minimum spanning tree from point 0
    near, via, inside, edges = reach[0].copy(), np.zeros(n, int), np.zeros(n, bool), []
    inside[0] = True
    for _ in range(n - 1):
        j = int(np.where(inside, np.inf, near).argmin())
        edges.append((float(near[j]), int(via[j]), j))
        inside[j] = True
        closer = ~inside & (reach[j] < near)
        near[closer], via[closer] = reach[j][closer], j
    edges.sort()
    w, u, v = (np.array(z) for z in zip(*edges, strict=True))
    return tree_clusters(n, u, v, w, least)


def tree_clusters(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels and strengths of density_clusters from the edges of the minimum spanning tree."""
    edges = sorted(zip(w.tolist(), u.tolist(), v.tolist(), strict=True))
    # single linkage as a binary tree: nodes n.. with children, distance, size
    left, right, height, size = {}, {}, {}, dict.fromkeys(range(n), 1)
    find_up: dict[int, int] = {}

    def find(a: int) -> int:
        while a in find_up:
            if find_up[a] in find_up:
                find_up[a] = find_up[find_up[a]]
            a = find_up[a]
        return a

    for k, (h, a, b) in enumerate(edges):
        a, b, new = find(a), find(b), n + k
        left[new], right[new], height[new], size[new] = a, b, h, size[a] + size[b]
        find_up[a] = find_up[b] = new

    def points(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            v = todo.pop()
            if v < n:
                out.append(v)
            else:
                todo += [left[v], right[v]]
        return out

    # condensed tree: cluster -> (birth, [(lambda, point)], children)
    top = 2 * n - 2
    birth, fallen, children = {0: 0.0}, {0: []}, {0: []}
    todo = [(top, 0)]
    while todo:
        node, cluster = todo.pop()
        if node < n:
            fallen[cluster].append((np.inf, node))
            continue
        lam = 1.0 / max(height[node], 1e-12)
        parts = [left[node], right[node]]
        big = [p for p in parts if size[p] >= least]
        if len(big) == 2:
            for p in parts:
                new = len(birth)
                birth[new], fallen[new], children[new] = lam, [], []
                children[cluster].append(new)
                todo.append((p, new))
        else:
            for p in parts:
                if p in big:
                    todo.append((p, cluster))
                else:
                    fallen[cluster] += [(lam, q) for q in points(p)]
    total = {c: len(fallen[c]) for c in birth}
    mass, chosen = {}, {}
    for c in sorted(birth, reverse=True):
        total[c] += sum(total[k] for k in children[c])
        highest = max([lam for lam, _ in fallen[c] if np.isfinite(lam)] + [birth[k] for k in children[c]] + [birth[c]])
        own = sum(min(lam, highest) - birth[c] for lam, _ in fallen[c]) + sum((birth[k] - birth[c]) * total[k] for k in children[c])
        below = sum(mass[k] for k in children[c])
        chosen[c] = c != 0 and (not children[c] or own >= below)
        mass[c] = own if chosen[c] else below
    label, strength = np.full(n, -1), np.zeros(n)
    todo, found = [0], 0
    while todo:
        c = todo.pop(0)
        if not chosen[c]:
            todo += children[c]
            continue
        members, stack = [], [c]
        while stack:
            k = stack.pop()
            members += fallen[k]
            stack += children[k]
        finite = [lam for lam, _ in members if np.isfinite(lam)]
        most = max(finite) if finite else 1.0
        for lam, q in members:
            label[q], strength[q] = found, min(lam, most) / most
        found += 1
    return label, strength


def cluster_points(x: np.ndarray, least: int | None = None, neighbours: int | None = None) -> tuple[np.ndarray, np.ndarray, str]:
    """Labels, strengths and the method: density clusters, or average linkage where these find fewer than two."""
    auto = automatic_settings(len(x))
    label, strength = density_clusters(reduce_dimensions(x), least or auto[0], neighbours or auto[1])
    if label.max(initial=-1) >= 1:
        return label, strength, "hdbscan"
    return linked_points(x)


def linked_points(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
    k = min(max(2, min(24, round(math.sqrt(len(x)) / 2))), len(x))
    label = average_linkage(x, k) if len(x) <= EXACT_POINTS else chained_linkage(x, k)
    return label, np.ones(len(x)), "agglomerative_fallback"


def parent_partition(x: np.ndarray) -> tuple[np.ndarray | None, float | None]:
    """The best cut of the leaf centroids into up to 8 groups, or none."""
    n, best = len(x), (-1.0, None, None)
    if n < 4:
        return None, None
    for k in range(2, min(8, max(2, n // 2)) + 1):
        label = average_linkage(x, k)
        sizes = np.bincount(label)
        if (sizes > 1).sum() < min(3, max(2, n // 4)) or sizes.max() / n > 0.65:
            continue
        score = silhouette(x, label)
        if score - 0.01 * k > best[0]:
            best = (score - 0.01 * k, label, score)
    return best[1], best[2]


def split_groups(ids: list[str], x: np.ndarray, score: float) -> list[tuple[list[str], float]]:
    """A parent group cut further while its parts are clearly apart."""
    best = (-1.0, None)
    if len(ids) >= 5:
        for k in range(2, min(4, len(ids) // 2) + 1):
            label = average_linkage(x, k)
            sizes = np.bincount(label)
            if sizes.min() >= 2 and sizes.max() / len(ids) <= 0.75 and (s := silhouette(x, label)) >= 0.12 and s > best[0]:
                best = (s, label)
    if best[1] is None:
        return [(ids, score)]
    out = []
    for g in range(best[1].max() + 1):
        rows = np.flatnonzero(best[1] == g)
        out += split_groups([ids[i] for i in rows], x[rows], best[0])
    return out


def taxonomy_groups(leaves: list[tuple[str, list[float]]]) -> list[tuple[list[str], float]]:
    """Parent groups of the leaf concepts (id, centroid); groups of one are left out, their leaf goes to the root."""
    leaves = sorted(leaves)
    x = np.array([v for _, v in leaves], dtype=float)
    label, score = parent_partition(x) if leaves else (None, None)
    if label is None:
        return []
    out = []
    for g in range(label.max() + 1):
        rows = np.flatnonzero(label == g)
        out += split_groups([leaves[i][0] for i in rows], x[rows], float(score))
    return [(sorted(ids), s) for ids, s in out if len(ids) > 1]

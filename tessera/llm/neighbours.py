"""Problem 4: the most similar vectors of every vector, by learned partitions.

A bounded sample gives an exact neighbour graph, which is cut into balanced partitions
(bisection, then moves that keep neighbours together within a capacity). A softmax
classifier learns the partitions of a vector and its neighbours; it puts every row into
its most probable partition and sends every query to several. Each partition is searched
exactly, in blocks of bounded size, so a partition that holds many rows is spread over
many tasks.

The number of partitions grows with the rows, so a partition keeps its size and the work
of a query does not grow. Up to FAN_OUT partitions one classifier tells them apart. Beyond,
there are two levels: cells of FAN_OUT partitions each, told apart by a first classifier,
and in every cell a classifier of its own, fitted in the cluster on a bounded sample of the
cell's rows. A query goes to the partitions that are most probable over both levels.

Exact copies of a vector are one row of the search; every copy gets its neighbours back.

Defined cases: null, empty, all-zero, non-finite and odd-length vectors take no part; equal
similarities are ordered by id; a repeated id counts once; fewer than k others give fewer.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.runtime import cut_lineage, read_table

#: Rows of a partition, partitions told apart by one classifier, and the bound of the sample a classifier is fitted on.
ROWS, FAN_OUT, SAMPLE, SAMPLE_PER_PARTITION = 1500, 256, 12_000, 32
#: Numbers of a cell's partitions begin at its own number times this (more than any cell can have).
CELL_SPAN = 1 << 20
#: Bytes of classifiers sent to the executors at once; more cells are taken in several passes over the rows.
ROUTER_BYTES = 64 << 20
#: Partitions up to this many (16 bytes each) are broadcast with their numbers of blocks; beyond it the join shuffles.
BROADCAST_PARTITIONS = 500_000
#: Bytes of rows compared in one task, about.
TASK_BYTES = 64 << 20
#: Partitions asked per query where only close pairs matter, and where all k neighbours do.
CLOSE_PROBES, WIDE_PROBES = 4, 48
INDEX_BLOCK, QUERY_BLOCK, AT_ONCE, EXACT_AT_ONCE = 4096, 16384, 512, 100_000


def neighbour_graph(x: np.ndarray, k: int = 10) -> np.ndarray:
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), dtype=np.int64)
    for low in range(0, len(x), AT_ONCE):
        s = x[low : low + AT_ONCE] @ x.T
        s[np.arange(len(s)), np.arange(low, low + len(s))] = -9
        out[low : low + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.1) -> tuple[np.ndarray, np.ndarray]:
    """Partition of each row, and how many of its neighbours lie in each partition."""
    label = np.zeros(len(x), dtype=np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    rng = np.random.default_rng(7)
    while todo:
        rows, first, count = todo.pop()
        if count == 1 or len(rows) < 2:
            label[rows] = first
            continue
        y = x[rows] - x[rows].mean(axis=0)
        v = rng.standard_normal(x.shape[1]).astype(np.float32)
        for _ in range(12):  # first principal direction
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) + 1e-12
        order = rows[np.argsort(y @ v, kind="stable")]
        half = count // 2
        cut = len(order) * half // count
        todo += [(order[:cut], first, half), (order[cut:], first + half, count - half)]
    most = math.ceil(len(x) / parts * slack)
    own = np.arange(len(x))
    for _ in range(rounds):
        near = np.zeros((len(x), parts), dtype=np.int16)
        np.add.at(near, (np.repeat(own, graph.shape[1]), label[graph].ravel()), 1)
        wanted = near.argmax(axis=1)
        gain = near[own, wanted] - near[own, label]
        load, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if load[wanted[i]] < most:
                load[label[i]] -= 1
                load[wanted[i]] += 1
                label[i] = wanted[i]
                moved += 1
        if moved < len(x) // 200:
            break
    near = np.zeros((len(x), parts), dtype=np.int16)
    np.add.at(near, (np.repeat(own, graph.shape[1]), label[graph].ravel()), 1)
    return label, near


def fit_router(x: np.ndarray, parts: int, epochs: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a softmax classifier trained (Adam) on the partitions of a row and of its neighbours."""
    if parts == 1:
        return np.zeros((x.shape[1], 1), np.float32), np.zeros(1, np.float32)
    label, near = balanced_partition(x, neighbour_graph(x), parts)
    near[np.arange(len(x)), label] += 5
    w, b = np.zeros((x.shape[1], parts), np.float32), np.zeros(parts, np.float32)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    rng, step = np.random.default_rng(11), 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for low in range(0, len(x), 512):
            rows = order[low : low + 512]
            goal = near[rows].astype(np.float32)
            goal /= goal.sum(axis=1, keepdims=True)
            z = x[rows] @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = (p - goal) / len(rows)
            step += 1
            for value, grad, m, v in ((w, x[rows].T @ d, state[0], state[1]), (b, d.sum(axis=0), state[2], state[3])):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= 0.3 * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w, b


def usable(df: DataFrame, dimensions: int) -> DataFrame:
    """df: id, vec. Rows that can be compared."""
    v = F.col("vec")
    sound = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    return df.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) == dimensions) & sound).select("id", v.cast("array<float>").alias("vec"))


def distinct_vectors(df: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: id (the smallest), ids (the k + 1 smallest), vec. Each task keeps k + 1 ids of a vector before the exchange."""
    keyed = df.withColumn("h", F.xxhash64("vec"))
    few = keyed.withColumn("n", F.dense_rank().over(Window.partitionBy("h").orderBy("id"))).where(F.col("n") <= k + 1)
    return few.groupBy("h").agg(F.min("id").alias("id"), F.array_sort(F.collect_set("id")).alias("ids"), F.first("vec").alias("vec"))


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _best(z: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, in order."""
    k = min(k, z.shape[1])
    best = np.argpartition(-z, k - 1, axis=1)[:, :k]
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(z, best, axis=1), axis=1, kind="stable"), axis=1)


def _arrays(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Rows of a matrix as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel(), kind))


def _sampled(rows: DataFrame, total: int, wanted: int) -> DataFrame:
    share = min(1.0, wanted * 1.1 / max(total, 1))
    return rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < math.ceil(1_000_000 * share))


def _vectors(batch_column: pa.Array, dimensions: int) -> np.ndarray:
    x = batch_column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def routed_rows(base: DataFrame, dimensions: int, probes: int, total: int) -> DataFrame:
    """base: id, vec, asks. (id, vec, asks, parts): unit vectors as bytes and their most probable partitions (one for a row that doesn't ask), best first."""
    spark = base.sparkSession
    parts = max(1, math.ceil(total / ROWS))
    cells = 1 if parts <= FAN_OUT else math.ceil(parts / FAN_OUT)
    first = cells if cells > 1 else parts
    wanted = max(SAMPLE, SAMPLE_PER_PARTITION * first)
    sample = np.array([r[0] for r in _sampled(base, total, wanted).select("vec").limit(wanted).collect()], dtype=np.float32).reshape(-1, dimensions)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    first = max(1, min(first, len(sample) // 8))
    router = spark.sparkContext.broadcast(fit_router(sample, first))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = router.value
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(1), dimensions)
                z = _log_softmax(x @ w + b)
                best = _best(z, probes)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2), _arrays(best, pa.int64()), _arrays(np.take_along_axis(z, best, axis=1), pa.float32())], names=["id", "vec", "asks", "parts", "odds"])

    # every row is shown its most probable partitions; one that doesn't ask needs the first only
    rows = base.select("id", "vec", "asks").mapInArrow(route, "id string, vec binary, asks boolean, parts array<long>, odds array<float>")
    if cells == 1:
        return cut_lineage(rows.withColumn("parts", F.when(F.col("asks"), F.col("parts")).otherwise(F.slice("parts", 1, 1))).drop("odds"))
    rows = cut_lineage(rows)
    return _routed_in_cells(rows, dimensions, probes, total)


def _routed_in_cells(rows: DataFrame, dimensions: int, probes: int, total: int) -> DataFrame:
    """The second level: rows with their most probable cells to their most probable partitions."""
    spark = rows.sparkSession
    own = F.col("parts")[0]
    most = SAMPLE_PER_PARTITION * FAN_OUT
    held = rows.select("id", "vec", own.alias("cell"))
    sizes = held.groupBy("cell").agg(F.count("*").alias("n"))
    # about SAMPLE_PER_PARTITION rows for each partition, and never more than twice a full cell's for one cell
    kept = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id"))
    sample = _sampled(held, total, math.ceil(total / ROWS) * SAMPLE_PER_PARTITION).withColumn("k", kept).where(F.col("k") <= 2 * most).join(sizes, "cell")

    def fit(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), dtype=np.float32).reshape(-1, dimensions)
        wanted = math.ceil(table.column("n")[0].as_py() / ROWS)
        w, b = fit_router(x, max(1, min(wanted, len(x) // 8)))
        return pa.table({"cell": table.column("cell").slice(0, 1), "w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "b": pa.array([b.astype(np.float32).tobytes()], pa.binary())})

    fitted = cut_lineage(sample.groupBy("cell").applyInArrow(fit, "cell long, w binary, b binary"))
    size = fitted.agg(F.sum(F.length("w") + F.length("b"))).first()[0] or 0
    passes = max(1, math.ceil(size / ROUTER_BYTES))
    found = None
    for turn in range(passes):
        here = F.pmod(F.xxhash64("cell"), F.lit(passes)) == turn
        sent = spark.sparkContext.broadcast({r[0]: (np.frombuffer(r[1], np.float32).reshape(dimensions, -1), np.frombuffer(r[2], np.float32)) for r in fitted.where(here).collect()})

        def route(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float32).reshape(-1, dimensions)
                asks = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
                cells = batch.column(3).flatten().to_numpy().reshape(len(x), -1)
                odds = batch.column(4).flatten().to_numpy().reshape(len(x), -1)
                part, score = np.full((len(x), probes), -1, np.int64), np.full((len(x), probes), -np.inf, np.float32)
                for k in range(cells.shape[1]):
                    for cell in np.unique(cells[:, k]):
                        if int(cell) not in sent.value:
                            continue
                        who = np.flatnonzero((cells[:, k] == cell) & (asks | (k == 0)))
                        w, b = sent.value[int(cell)]
                        z = _log_softmax(x[who] @ w + b) + odds[who, k][:, None]
                        best = _best(z, probes)
                        both = np.concatenate([score[who], np.take_along_axis(z, best, axis=1)], axis=1)
                        names = np.concatenate([part[who], cell * CELL_SPAN + best], axis=1)
                        top = _best(both, probes)
                        score[who], part[who] = np.take_along_axis(both, top, axis=1), np.take_along_axis(names, top, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _arrays(part, pa.int64()), _arrays(score, pa.float32())], names=["id", "vec", "asks", "parts", "odds"])

        part = rows.mapInArrow(route, "id string, vec binary, asks boolean, parts array<long>, odds array<float>")
        found = part if found is None else found.unionByName(part)
    if passes > 1:  # the best of all passes; only ids and a few numbers are gathered
        pairs = F.arrays_zip(F.col("odds").alias("odds"), F.col("parts").alias("parts"))
        best = found.select("id", pairs.alias("p")).groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("p")), asc=False), 1, probes).alias("p"))
        found = rows.select("id", "vec", "asks").join(best.select("id", F.col("p.parts").alias("parts")), "id")
    known = F.filter("parts", lambda c: c >= 0)
    return cut_lineage(found.select("id", "vec", "asks", F.when(F.col("asks"), known).otherwise(F.slice(known, 1, 1)).alias("parts")))


def search(base: DataFrame, dimensions: int, k: int, probes: int, least: float) -> DataFrame:
    """base: id, vec, asks, one row per distinct vector. (id, other, similarity): the k best of each query row with similarity of at least `least`."""
    spark = base.sparkSession
    total = base.count()
    if not total:
        return spark.createDataFrame([], "id string, other string, similarity double")
    routed = routed_rows(base, dimensions, probes, total)
    # how a partition is cut into blocks: a row a partition, joined
    held = routed.groupBy(F.col("parts")[0].alias("p")).agg(F.ceil(F.count("*") / INDEX_BLOCK).cast("int").alias("blocks"))
    asked = routed.where("asks").select(F.explode("parts").alias("p")).groupBy("p").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("queries"))
    cut = cut_lineage(held.join(asked, "p", "left").withColumn("queries", F.coalesce("queries", F.lit(1))))
    shape = cut.agg(F.count("*").alias("parts"), F.sum(F.col("blocks").cast("long") * F.col("queries")).alias("n")).first()
    if shape["parts"] <= BROADCAST_PARTITIONS:
        cut = F.broadcast(cut)
    hashed = F.xxhash64("id")
    index = routed.select("id", "vec", F.col("parts")[0].alias("p")).join(cut, "p")
    index = index.select("id", "vec", "p", F.pmod(hashed, F.col("blocks")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("queries") - 1)).alias("q"), F.lit(False).alias("asks"))
    asking = routed.where("asks").select("id", "vec", F.explode("parts").alias("p")).join(cut, "p")  # a partition may hold no row
    asking = asking.select("id", "vec", "p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.pmod(hashed, F.col("queries")).cast("int").alias("q"), F.lit(True).alias("asks"))
    size = (total + routed.where("asks").count() * probes) * (4 * dimensions + 60)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(shape["n"]), math.ceil(size / TASK_BYTES)))

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids = np.array(table.column("id").to_pylist(), dtype=object)
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), dtype=np.float32).reshape(-1, dimensions)
        order = np.argsort(ids[~asks], kind="stable")  # so that equal similarities come in order of id
        names, rows = ids[~asks][order], x[~asks][order]
        who, other, score = [], [], []
        if len(names):
            for low in range(0, int(asks.sum()), AT_ONCE):
                mine, q = ids[asks][low : low + AT_ONCE], x[asks][low : low + AT_ONCE]
                s = q @ rows.T
                floor = np.full(len(s), least - 1e-5)
                # where more than k + 1 qualify (oneself among them), those below the (k + 1)-th best can't be among the k
                many = np.flatnonzero((s >= floor[:, None]).sum(axis=1) > k + 1)
                if len(many):
                    floor[many] = np.maximum(floor[many], np.partition(s[many], s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1] - 2e-6)
                r, c = np.nonzero(s >= floor[:, None])
                other_than = mine[r] != names[c]
                r, c = r[other_than], c[other_than]
                exact = np.empty(len(r))
                for at in range(0, len(r), EXACT_AT_ONCE):  # many may be equal
                    part = slice(at, at + EXACT_AT_ONCE)
                    exact[part] = np.einsum("ij,ij->i", q[r[part]].astype(np.float64), rows[c[part]].astype(np.float64))
                kept = exact >= least
                r, c, exact = r[kept], c[kept], exact[kept]
                by = np.lexsort((c, -exact, r))
                r, c, exact = r[by], c[by], exact[by]
                first = np.searchsorted(r, r)
                kept = np.arange(len(r)) - first < k
                who.append(mine[r[kept]])
                other.append(names[c[kept]])
                score.append(exact[kept])
        join = lambda v, kind: pa.array(np.concatenate(v) if v else [], kind)
        return pa.table({"id": join(who, pa.string()), "other": join(other, pa.string()), "similarity": join(score, pa.float64())})

    found = index.unionByName(asking).repartition(tasks, "p", "i", "q").groupBy("p", "i", "q").applyInArrow(compare, "id string, other string, similarity double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return found.withColumn("n", rank).where(F.col("n") <= k).drop("n")


def most_similar(df: DataFrame, dimensions: int, k: int = 5, probes: int = WIDE_PROBES, least: float = -2.0, query: Callable[[Column], Column] = lambda c: F.lit(True)) -> DataFrame:
    """df: id, vec. (id, other, similarity) for every id for which the condition `query` holds, copies included."""
    rows = usable(df, dimensions)
    # a vector is asked for if one of its ids is; with more than k + 1 ids its own copies are the whole answer
    base = cut_lineage(distinct_vectors(rows, k).withColumn("asks", F.exists("ids", query)))
    found = search(base, dimensions, k, probes, least)
    copied = base.where(F.size("ids") > 1)
    if copied.isEmpty():
        return found  # one id per vector, so exactly the ids asked for
    # with copies: a vector's answer is its own copies (similarity 1) and the copies of its neighbours, k + 1 names at most
    found = cut_lineage(found)
    names = base.select(F.col("id").alias("other"), "ids")
    own = copied.select("id", F.col("id").alias("other"), F.lit(1.0).alias("similarity"))
    wide = found.unionByName(own).join(names, "other").select("id", F.explode("ids").alias("other"), "similarity")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    wide = wide.withColumn("n", rank).where(F.col("n") <= k + 1).drop("n").withColumnRenamed("id", "first")
    members = rows.select("id", F.xxhash64("vec").alias("h")).distinct().join(base.select("h", F.col("id").alias("first")), "h").select("id", "first").where(query(F.col("id")))
    again = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    out = members.join(wide, "first").where("id <> other").withColumn("n", F.row_number().over(again)).where(F.col("n") <= k)
    return out.select("id", "other", "similarity")


def chunk_vectors(spark: SparkSession, sf_dir: str, model: str = "lumen-multi-64") -> DataFrame:
    chunks = read_table(spark, sf_dir, "chunks")
    return chunks.where(F.col("embedding_model") == model).select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vec"))


def term_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "terms").select(F.col("term_id").alias("id"), F.col("resolver_embedding").alias("vec"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of cosine 0.95 or more where one is among the other's 5 most similar."""
    found = [most_similar(df, d, k=5, probes=CLOSE_PROBES, least=0.95) for df, d in ((chunk_vectors(spark, sf_dir), 64), (term_vectors(spark, sf_dir), 48))]
    return found[0].unionByName(found[1]).select(F.least("id", "other").alias("left_id"), F.greatest("id", "other").alias("right_id")).distinct()


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar of every twentieth row (the ids are text, so by the number that the first digits of their md5 make), among all rows."""
    query = lambda c: F.conv(F.left(F.md5(c), F.lit(8)), 16, 10).cast("long") % 20 == 0
    chunks, terms = (most_similar(df, d, query=query).withColumn("kind", F.lit(kind)) for df, d, kind in ((chunk_vectors(spark, sf_dir), 64, "chunk"), (term_vectors(spark, sf_dir), 48, "term")))
    return chunks.unionByName(terms).select("kind", "id", "other", F.round("similarity", 6).alias("similarity"))


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the similarity, whose last digits depend on the order of sums; exact where all partitions are asked (up to about 70,000 rows)."""
    return p4_neighbours(spark, sf_dir).select("kind", "id", "other")


QUERIES = {"p4_found": p4_found, "p4_neighbours": p4_neighbours, "p4_nearest": p4_nearest}


def _brute(table: str, key: str, vec: str, condition: str) -> str:
    """All pairs of a table, for the small tables of the check."""
    usable = f"SELECT {key} AS id, any_value({vec})::DOUBLE[] AS v FROM {table} WHERE {key} IS NOT NULL AND {vec} IS NOT NULL AND {condition} AND list_max(list_transform({vec}, lambda x: abs(x))) > 0 GROUP BY {key}"
    return f"""(WITH u AS ({usable}), s AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.id <> b.id),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS n FROM s WHERE s >= 0.95) SELECT DISTINCT least(id, other) AS left_id, greatest(id, other) AS right_id FROM r WHERE n <= 5)"""


def _nearest(kind: str, table: str, key: str, vec: str, condition: str) -> str:
    """The 5 most similar of every twentieth row by comparison with all rows."""
    usable = f"SELECT {key} AS id, any_value({vec})::DOUBLE[] AS v FROM {table} WHERE {key} IS NOT NULL AND {vec} IS NOT NULL AND {condition} AND list_max(list_transform({vec}, lambda x: abs(x))) > 0 GROUP BY {key}"
    return f"""(WITH u AS ({usable}), s AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.id <> b.id WHERE ('0x' || left(md5(a.id), 8))::BIGINT % 20 = 0)
        SELECT '{kind}' AS kind, id, other FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, other) <= 5)"""


_CHUNK_ROWS, _TERM_ROWS = ("chunks", "chunk_id", "embedding", "embedding_model = 'lumen-multi-64' AND len(embedding) = 64"), ("terms", "term_id", "resolver_embedding", "len(resolver_embedding) = 48")
ORACLE = {"p4_found": _brute(*_CHUNK_ROWS) + " UNION ALL " + _brute(*_TERM_ROWS), "p4_nearest": _nearest("chunk", *_CHUNK_ROWS) + " UNION ALL " + _nearest("term", *_TERM_ROWS)}

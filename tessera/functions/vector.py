"""Vector expressions and the broadcast matrix product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Rows times dimensions of a matrix that may be broadcast (8 bytes each, so 64 MB).
BROADCAST_NUMBERS = 8_000_000
#: Groups whose vectors may be broadcast for a join.
BROADCAST_GROUPS = 10_000


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, inside the JVM: for few pairs."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def usable(vec: Column) -> Column:
    """Not null, no null inside, not all zero."""
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull()) & F.exists(vec, lambda x: x != 0)


def unit(vec: Column) -> Column:
    length = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vec, lambda x: x.cast("double") / length)


def centroids(df: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, centroid): unit mean vector of each group. Sums are combined in each task before the exchange."""
    parts = df.select(group, F.posexplode(vec).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    return mean.select(group, unit(F.col("mean")).alias("centroid"))


def similarities(df: DataFrame, key: str, vec: str, matrix: DataFrame, name: str, vector: str, top: int | None = None) -> DataFrame:
    """(key, name, similarity): cosine of every row with every row of a small matrix, as one matrix product per batch.

    top: only so many of the most similar of each row, by the similarity rounded to 6 places, then the name; they are
    picked in the batch, so nothing more is handed on. The matrix is collected after its size is checked; beyond the
    bound it is taken in blocks of rows, one pass each.
    """
    name_type = to_arrow_type(matrix.schema[name].dataType)
    rows = matrix.where(usable(F.col(vector))).select(name, vector).distinct()
    size = rows.agg(F.count("*"), F.max(F.size(vector))).first()
    kind = df.schema[key].dataType.simpleString(), matrix.schema[name].dataType.simpleString()
    schema = f"`{key}` {kind[0]}, `{name}` {kind[1]}, similarity double"
    if not size[0]:
        return df.sparkSession.createDataFrame([], schema)
    blocks = -(-size[0] * size[1] // BROADCAST_NUMBERS)
    out = None
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64(name), F.lit(blocks)) == b)
        held = sorted((r[0], r[1]) for r in part.collect())
        if not held:
            continue
        m = np.array([h[1] for h in held], dtype=float)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        sent = df.sparkSession.sparkContext.broadcast((np.array([h[0] for h in held], dtype=object), m))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, m = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
                s = (x @ m.T) / np.linalg.norm(x, axis=1, keepdims=True)
                # names are in order, so a stable sort leaves equal similarities in that of the names
                best = np.tile(np.arange(len(names)), (len(x), 1)) if top is None else np.argsort(-np.round(s, 6), axis=1, kind="stable")[:, :top]
                at = pa.array(np.repeat(np.arange(len(x)), best.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(names[best.ravel()], name_type), pa.array(np.take_along_axis(s, best, axis=1).ravel())], names=[key, name, "similarity"])

        fitting = df.where(usable(F.col(vec)) & (F.size(vec) == size[1])).select(key, vec)
        block = fitting.mapInArrow(run, schema)
        out = block if out is None else out.unionByName(block)
    if top is None or blocks == 1:
        return out
    order = Window.partitionBy(key).orderBy(F.desc(F.round("similarity", 6)), name)
    return out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top).drop("_n")


def own_similarity(df: DataFrame, key: str, vec: str, group: str, centres: DataFrame, name: str, vector: str) -> DataFrame:
    """(key, group, similarity): cosine of every row with the vector of its own group, which is joined (one row per group)."""
    rows = df.where(usable(F.col(vec)) & F.col(group).isNotNull()).select(key, F.col(group).alias("_group"), F.col(vec).alias("_v"))
    right = centres.select(F.col(name).alias("_group"), F.col(vector).alias("_c"))
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    joined = rows.join(F.broadcast(right) if right.count() <= BROADCAST_GROUPS else right, "_group")
    return joined.select(key, F.col("_group").alias(group), (dot(F.col("_v"), F.col("_c")) / length("_v") / length("_c")).alias("similarity"))

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.sources import store, tables

COLUMNS = "chunk_id string, text string, updated_at int, embedding array<float>"


def write(spark, folder, rows):
    spark.createDataFrame(rows, COLUMNS).write.mode("overwrite").parquet(f"{folder}/chunks.parquet")


def test_stored_once_and_made_anew_for_other_files(spark, tmp_path):
    folder, made = str(tmp_path), []
    write(spark, folder, [("a", "old", 1, None), ("a", "new", 2, None), ("b", None, None, None), (None, "x", 1, None)])

    def make():
        made.append(1)
        return spark.range(3).withColumn("part", F.col("id") % 2)

    for _ in range(3):
        assert store.stored(spark, folder, "three", make, by="part").count() == 3
    assert len(made) == 1
    assert sorted((r.chunk_id, r.text) for r in tables.chunks(spark, folder, "text").collect()) == [("a", "new"), ("b", None)]
    write(spark, folder, [("a", "newest", 9, None)])
    assert [r.text for r in tables.chunks(spark, folder, "text").collect()] == ["newest"]
    assert store.stored(spark, folder, "three", make, by="part").count() == 3 and len(made) == 2
    assert store.clear(spark, folder, "three") == ["three"] and store.clear(spark, folder) == ["chunks"] and store.clear(spark, folder) == []
    write(spark, folder, [])
    assert tables.chunks(spark, folder).count() == 0


def test_latest_run(spark):
    rows = spark.createDataFrame([("r1", 5), ("r1", 9), ("r2", 7), ("r2", None), (None, 20)], "run_id string, updated_at int")
    assert [r.run_id for r in graph.latest_run(rows, "run_id", "updated_at").collect()] == ["r1"]
    tied = spark.createDataFrame([("b", 1), ("a", 1)], "run_id string, updated_at int")
    assert [r.run_id for r in graph.latest_run(tied, "run_id", "updated_at").collect()] == ["a"]
    assert graph.latest_run(rows.where("run_id IS NULL"), "run_id", "updated_at").count() == 0


def test_clearing_a_layer_leaves_the_other(spark):
    layers = {"Chunk": ("provenance", spark.range(4)), "Term": ("semantic", spark.range(2)), "Page": ("provenance", spark.range(0))}
    for layer, want in (("provenance", {"Chunk": (4, 4), "Term": (2, 0)}), ("semantic", {"Chunk": (4, 0), "Term": (2, 2)})):
        assert {r.label: (r.stored, r.removed) for r in graph.cleared(layers, layer).collect()} == want
    with pytest.raises(FileExistsError):
        graph.refuse_existing(graph.label_counts(Chunk=spark.range(1)), allowed=False)

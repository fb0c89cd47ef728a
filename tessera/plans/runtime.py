"""Session-level helpers: shared folder, partition spread, table reading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; set one only where it is unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", "")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master == "local" or sc.master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    else:
        raise ValueError("spark.checkpoint.dir is not set; name a folder that all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder, so a lost executor costs nothing computed so far."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_packed(df: DataFrame) -> DataFrame:
    """As cut_lineage, for large tables: compressed columns instead of rows. They are deleted when the driver ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(sc._jsc.sc().getCheckpointDir().get(), f"packed-{uuid.uuid4().hex}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.option("compression", "zstd").parquet(path.toString())
    return spark.read.schema(df.schema).parquet(path.toString())


def spread(df: DataFrame) -> DataFrame:
    """Repartition only where the scan gives fewer tasks than there are cores (one small file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

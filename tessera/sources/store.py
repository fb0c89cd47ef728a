"""Tables that are made once and read by many queries, kept in the shared folder.

A load writes the node table of the chunks (one row per id), the concept edges and the text
index; queries read stored rows. A table is kept under a digest of the files it is made
from (path, length, time) and of the code that makes it, so changed files or rules give a
new table. A table is written to a folder of its own and renamed when it is whole, so a
load that is lost leaves nothing half.
"""

from __future__ import annotations

import functools
import hashlib
import pathlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.runtime import ensure_checkpoint_dir

INPUTS = ("chunks", "terms", "concepts", "source_documents", "taxonomy_edges")


@functools.cache
def _code() -> str:
    """A digest of the modules that make stored tables."""
    package = pathlib.Path(__file__).resolve().parent.parent
    files = [f for part in ("functions", "operators", "plans", "sources") for f in sorted((package / part).glob("*.py"))]
    return hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()


def _listed(spark: SparkSession, folder: str) -> str:
    """A digest of path, length and time of all files of the input tables."""
    jvm = spark.sparkContext._jvm
    out = [_code()]
    for name in INPUTS:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path):
            continue
        for status in system.listStatus(path):
            out.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(out)).encode()).hexdigest()[:24]


def _root(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    return f"{named or spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tessera-tables"


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """The table of that name, made where it is not stored yet. by: a column its folders are named by."""
    folder = f"{_root(spark)}/{_listed(spark, sf_dir)}/{name}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(conf)
    if not system.exists(path):
        making = f"{folder}-{uuid.uuid4().hex}"
        writer = make().write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(making)
        whole = jvm.org.apache.hadoop.fs.Path(making)
        if system.exists(path) or not system.rename(whole, path):  # another session was first
            system.delete(whole, True)
        # a rename to a folder that has just come to be puts this one inside it
        inside = jvm.org.apache.hadoop.fs.Path(path, whole.getName())
        if system.exists(inside):
            system.delete(inside, True)
    return spark.read.parquet(folder)


def clear(spark: SparkSession, sf_dir: str, *names: str) -> list[str]:
    """Removes stored tables of these names (all where none is named), whatever files they were made from; the names removed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(f"{_root(spark)}/{_listed(spark, sf_dir)}")
    system = base.getFileSystem(conf)
    if not system.exists(base):
        return []
    held = [s.getPath() for s in system.listStatus(base)]
    gone = [p for p in held if not names or p.getName() in names]
    for p in gone:
        system.delete(p, True)
    return sorted(p.getName() for p in gone)

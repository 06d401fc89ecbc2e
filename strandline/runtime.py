"""What every job needs before it runs Python on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a local one if all runs on this machine, as in tests, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        found = f"file://{tempfile.gettempdir()}/strandline-scratch"
    return found.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path, as Spark's readers see it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = hadoop(spark, path)
    return store.exists(place)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver ends."""
    store, place = hadoop(spark, path)
    store.deleteOnExit(place)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is written within this block gives its shuffle files back once it is there, not when the driver happens to collect garbage; a session's own setting comes back after it."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if had is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, had)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: what follows survives lost executors and computes it once.

    The files go when :func:`drop` is told that nothing reads them any more, and
    at the latest when the driver ends. The shuffles that made the table are
    gone when it is there.
    """
    path = new_path(df.sparkSession, name)
    with shuffles_go(df.sparkSession):
        df.write.parquet(path)
    drop_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for df in tables:
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            store, place = hadoop(spark, folder)
            store.delete(place, True)

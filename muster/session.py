"""Session settings the library counts on, and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Runtime settings.  The forced skew-join rule lets a join on a hot cluster be split even where an
# aggregation on the same key follows: the partial aggregation then runs before the added shuffle.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def build_session(app: str = "muster", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """An SQL option for the jobs run within the block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table written between two steps.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``, under the application's id, so that all a
    finished application has written can be removed at once.  Only a local session without that setting gets a
    temporary folder, which goes with the program: executors on other machines could not read it.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = _local_folder()
    return f"{base.rstrip('/')}/{context.applicationId}/{name}-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _local_folder() -> str:
    path = tempfile.mkdtemp(prefix="muster-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours that no later step reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it does not exist."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []


def move_folder(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder, which a file system does in one step; the folder it goes to is made."""
    path, to = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    system = to.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(to.getParent())
    if not system.rename(path, to):
        raise OSError(f"cannot move {path} to {to}")


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, which says that something is done."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file, True).close()


@contextmanager
def written(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """A table written for the readers within the block, and removed after the last of them."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        remove_folder(df.sparkSession, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read, and go on from the written form.

    It cuts the lineage, so what follows is planned and, after a lost executor, redone from the files.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

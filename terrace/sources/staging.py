"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import DataFrame, SparkSession

# What the ``scratch`` blocks around the running code have staged; each run sees its own.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open scratch blocks", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else the warehouse.

    A warehouse in a machine's own file system will do only where all runs on that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local") and warehouse.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{warehouse}/_shared"
    return folder.rstrip("/")


def staged_folder(spark: SparkSession, kind: str = "staged") -> str:
    """A new folder, deleted at the end of the ``scratch`` blocks that are open."""
    path = f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"
    for block in _open.get():
        block.append(path)
    return path


def stage(df: DataFrame, spread: bool = True) -> DataFrame:
    """Write ``df`` once and return it as a Parquet relation.

    Unlike a cached plan the result survives the loss of executors, and unlike a
    checkpoint it keeps column pruning and has a true size, so that joins choose their
    strategy from what was really written. Rows are spread over files of a sensible size,
    since what is staged is often a thin remainder of a wide job; without ``spread`` the
    partitions stay as they are.
    """
    spark = df.sparkSession
    path = staged_folder(spark)
    (df.hint("rebalance") if spread else df).write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what is staged inside; nothing may read it afterwards.

    Inside means by this run: what other threads stage belongs to the blocks open there,
    unless they were started by ``in_threads``.
    """
    staged: list[str] = []
    token = _open.set((*_open.get(), staged))
    try:
        yield
    finally:
        _open.reset(token)
        for path in staged:
            remove_folder(spark, path)


def in_threads(work: Callable, items: Iterable, parallel: int) -> list:
    """``work`` for each item, several at a time, as part of the run that calls."""
    items = list(items)
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        return [f.result() for f in [pool.submit(copy_context().run, work, i) for i in items]]


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder, sorted."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(target) if f.isDirectory())

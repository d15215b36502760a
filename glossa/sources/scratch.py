"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where it is unset, as in tests, one of our own, but only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{_own_scratch()}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


@lru_cache(maxsize=1)
def _own_scratch() -> str:
    return tempfile.mkdtemp(prefix="glossa-scratch-")


_scopes: list[list[DataFrame]] = []


def materialize(df: DataFrame, name: str, scoped: bool = True) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if scoped and _scopes:
        _scopes[-1].append(out)
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that nothing reads any more; frames of another kind are left alone."""
    for df in frames:
        if path := getattr(df, "scratch_path", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Release at the end all frames materialized inside, but for those with scoped=False."""
    _scopes.append([])
    try:
        yield
    finally:
        release(*_scopes.pop())

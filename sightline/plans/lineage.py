"""Cutting lineage with a written table in storage that every executor shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has written and not yet deleted.
_written: list[str] = []


@lru_cache(maxsize=1)
def _local_default() -> str:
    return tempfile.mkdtemp(prefix="sightline-")


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and all work is in one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local_default()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the scratch folder; ``clear`` deletes it."""
    path = f"{scratch_dir(spark).rstrip('/')}/sightline-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: later jobs neither recompute it nor depend on an executor's copy."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Delete what was written, from the ``since``-th folder on; frames that read it can't be used any more."""
    gone = _written[since:]
    del _written[since:]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is materialized inside is deleted at the end; write what is to stay elsewhere before."""
    since = len(_written)
    try:
        yield
    finally:
        clear(spark, since)

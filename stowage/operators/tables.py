"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_made = threading.local()


#: Bytes of an Arrow batch, where the session has Spark's default.
_ARROW, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Python gets Arrow batches of bounded bytes, unless the session has its own bound."""
    if spark.conf.get(_ARROW, None) in (None, "67108864", "67108864b"):
        spark.conf.set(_ARROW, ARROW_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder for local sessions and an error for clusters."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = tempfile.mkdtemp(prefix="spark-tables-")
    return _local[sc.applicationId]


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder for a table, not there yet."""
    folder = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in getattr(_made, "scopes", [])[-1:]:
        scope.append(folder)
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends here, and lost executors lose nothing."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    back = df.sparkSession.read.schema(df.schema).parquet(folder)
    back.stored_in = folder
    return back


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables of this application, once its results are stored elsewhere."""
    delete(spark, _own_dir(spark))


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables made inside are deleted at the end, but for materialised ones that the function it gives is called with."""
    scopes = _made.__dict__.setdefault("scopes", [])
    own: list[str] = []
    outer = scopes[-1] if scopes else []
    scopes.append(own)

    def keep(table: DataFrame) -> DataFrame:
        own.remove(table.stored_in)
        outer.append(table.stored_in)
        return table

    try:
        yield keep
    finally:
        scopes.pop()
        for folder in own:
            delete(spark, folder)

"""Cut lineage by writing a table to the shared folder the cluster names."""
from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}
_local = threading.local()  # scopes of one thread are not another's


def _scopes() -> list[list[str]]:
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


def scratch_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a temporary folder only for a local master without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dir[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_dir[app]


def materialise(df: DataFrame, name: str = "t", keep: bool = False) -> DataFrame:
    """Write `df` once and read it back: later jobs start from files, which outlive any executor.

    Inside a `scope` the files go with it, unless `keep` is set.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/maskfold/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes() and not keep:
        _scopes()[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete what `materialise` writes inside, at the end. Write the result before, or with `keep`: frames that
    read the deleted tables fail."""
    _scopes().append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in _scopes().pop():
            place = hadoop.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

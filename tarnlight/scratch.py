"""Tables that cut lineage: written once to the cluster's shared folder and read back.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset (tests, a notebook) a folder of our own is
made, which is right in local mode alone.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tarnlight-"))
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tarnlight/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back.

    Unlike ``localCheckpoint`` the copy outlives any executor, and unlike ``cache`` it cuts the lineage. Inside
    ``temporary()`` the table goes at the end of the block, unless ``keep``: it then belongs to whoever uses the result.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    if _open and not keep:
        _open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete at the end of the block what is materialized in it, but for what is kept. Nothing lazy may outlive the block."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store; one that is gone already is left alone."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)

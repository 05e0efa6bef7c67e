"""Working folders and table reads that the corpus operators share."""

from __future__ import annotations

import atexit
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a session on one machine writes when it sets no folder.
LOCAL_DIR = "file:///tmp/lumenq-checkpoint"
#: Folders that are still there, and what deletes them after the session has ended.
_left: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; only a session in one JVM may leave it unset."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is unset; it must name a folder that all executors share")
    return LOCAL_DIR


def new_dir(spark: SparkSession, what: str) -> str:
    """A fresh path under the shared folder; nothing is created."""
    return f"{shared_dir(spark)}/lumenq-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The frame, written to the shared folder and read back: its lineage is cut and survives lost executors. The folder goes with ``drop``, or when the driver ends."""
    spark = df.sparkSession
    path = new_dir(spark, what)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    _left[path] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    return back


def _delete(path: str) -> None:
    jvm, conf = _left.pop(path)
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def drop(*frames: DataFrame) -> None:
    """Deletes the folders of frames from ``written`` that nothing reads any more."""
    for df in frames:
        _delete(df.written_to)


@atexit.register
def _sweep() -> None:
    for path in list(_left):
        try:
            _delete(path)
        except (Py4JError, OSError):  # the JVM has ended before
            return


#: Keys up to which a set of keys is broadcast to filter by (16 bytes each).
BROADCAST_KEYS = 4_000_000


def among(df: DataFrame, keys: DataFrame, column: str, limit: int = BROADCAST_KEYS) -> DataFrame:
    """The rows whose ``column`` is among ``keys``: by a broadcast of the keys if they are few enough, so that no other row is moved, else by a shuffle."""
    own = keys.select(column).distinct()
    return df.join(F.broadcast(own) if own.count() <= limit else own, column, "left_semi")


def without(df: DataFrame, keys: DataFrame, column: str, limit: int = BROADCAST_KEYS) -> DataFrame:
    """The rows whose ``column`` isn't among ``keys``, nulls included; as ``among``."""
    own = keys.select(column).distinct()
    return df.join(F.broadcast(own) if own.count() <= limit else own, column, "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_path(uri: str) -> str:
    """The mounted path of a ``file:`` URI, for writers that need plain files."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"not a mounted folder: {uri}")
    return uri

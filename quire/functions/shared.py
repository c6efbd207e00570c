"""Folders and tables that the whole cluster sees."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: By thread: lists of the folders that open scratch() blocks remove.
_SCRATCH = threading.local()


def root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a local one if all of Spark runs in this machine, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="quire-state-"))
    return _OWN[0]


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{root(spark)}/quire/{name}-{uuid.uuid4().hex[:12]}"
    for held in getattr(_SCRATCH, "held", ()):
        held.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What this thread writes with written() and new_folder() in here is removed at the end: for work whose result is written elsewhere."""
    if not hasattr(_SCRATCH, "held"):
        _SCRATCH.held = []
    own: list[str] = []
    _SCRATCH.held.append(own)
    try:
        yield
    finally:
        _SCRATCH.held.remove(own)
        jvm = spark.sparkContext._jvm
        for path in own:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df in as many partitions as a shuffle has, however small it is: for rows with which much is done each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: it is computed once and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cached(spark: SparkSession, name: str, version: str, make) -> DataFrame:
    """The table of make(), kept in the shared folder under a name and version. An entry that can't be read, or that no finished job wrote, is a miss and is made anew."""
    path = f"{root(spark)}/quire/cache/{name}/{version}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")):
        try:
            kept = spark.read.parquet(path)
            kept.limit(1).collect()
            return kept
        except Exception:  # noqa: BLE001  whatever is wrong with it, it is made anew
            fs.delete(at, True)
    # written beside and moved: who reads sees a whole entry or none
    beside = f"{path}-{uuid.uuid4().hex[:12]}"
    make().write.parquet(beside)
    fs.mkdirs(at.getParent())
    fs.delete(at, True)
    fs.rename(jvm.org.apache.hadoop.fs.Path(beside), at)
    return spark.read.parquet(path)

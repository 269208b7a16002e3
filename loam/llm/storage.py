"""Intermediate tables in the folder that driver and executors share, and what is freed once no later plan reads it."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .words import give_back

_LOCAL: dict[str, str] = {}


class Scratch:
    """Tables and broadcasts that were made while it was open; those not kept go when it closes."""

    def __init__(self) -> None:
        self.tables: dict[str, SparkSession] = {}
        self.broadcasts: list[Broadcast] = []

    def keep(self, *tables: DataFrame) -> None:
        """These tables (as written() returned them) are still read later: they pass to the scratch around this one, if any."""
        around = _OPEN[-2] if len(_OPEN) > 1 else Scratch()
        for t in tables:
            if spark := self.tables.pop(t._written_to, None):
                around.tables[t._written_to] = spark

    def close(self, spark: SparkSession) -> None:
        for b in self.broadcasts:
            b.destroy()
        for path in self.tables:
            remove(spark, path)
        # Spark deletes shuffle files when the driver's garbage is collected, which on a large heap can take long.
        gc.collect()
        spark._jvm.System.gc()
        give_back()


_OPEN: list[Scratch] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """What written() and shared() make in here is deleted at the end, unless it is kept or an error leaves the block."""
    own = Scratch()
    _OPEN.append(own)
    try:
        yield own
    finally:
        _OPEN.remove(own)
    own.close(spark)


def shared(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast, which ends with the scratch that is open."""
    out = spark.sparkContext.broadcast(value)
    if _OPEN:
        _OPEN[-1].broadcasts.append(out)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset on a local master, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        folder = tempfile.TemporaryDirectory(prefix="loam-")
        atexit.register(folder.cleanup)
        _LOCAL["dir"] = folder.name
    return _LOCAL["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loam-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, and it gives later joins the table's real size.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if _OPEN:
        _OPEN[-1].tables[path] = spark
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that no later plan reads."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)

"""Sinks that a run can be stopped in and begun again: whole-file replacement, marked shards, logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def replace(rows: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """Write rows beside path and move them there when they are whole, so that a reader sees the old rows or the new ones."""
    spark, beside = rows.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    rows.write.format(kind).options(**options).save(beside)
    new, fs = _fs(spark, beside)
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{beside}.old")
    if fs.exists(old):
        fs.rename(old, gone)
    if not fs.rename(new, old):
        fs.rename(gone, old)
        raise OSError(f"{beside} could not be moved to {path}")
    fs.delete(gone, True)


def write_documents(documents: DataFrame, path: str) -> None:
    """Documents as JSON by collection; collections that rows lack stay as they are."""
    documents.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").json(path)


def write_shards(rows: DataFrame, path: str, key: str, size: int = 2048, within: str = "category") -> None:
    """Rows of each `within` in shards of about `size` rows, dealt by the key's hash, sorted by the key; a category's shards are
    replaced as a whole, so none is left over. Spark's commit leaves _SUCCESS as the marker."""
    many = rows.groupBy(within).agg(F.ceil(F.count("*") / size).cast("int").alias("_shards"))
    placed = rows.join(many, within).withColumn("shard", F.pmod(F.xxhash64(key), F.col("_shards")).cast("int")).drop("_shards")
    placed.repartition(within, "shard").sortWithinPartitions(within, "shard", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(within, "shard").parquet(path)


def shard_is_done(spark: SparkSession, path: str) -> bool:
    """Whether a table was committed."""
    marker, fs = _fs(spark, f"{path.rstrip('/')}/_SUCCESS")
    return bool(fs.exists(marker))


def remove_stale(spark: SparkSession, path: str, kept: DataFrame, within: str = "category") -> list[str]:
    """Delete the partitions of `within` that kept doesn't name; their names."""
    folder, fs = _fs(spark, path)
    wanted = {r[0] for r in kept.select(F.col(within).cast("string")).distinct().collect()}
    gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith(f"{within}=") and s.getPath().getName().partition("=")[2] not in wanted]
    for p in gone:
        fs.delete(p, True)
    return sorted(p.getName().partition("=")[2] for p in gone)


def log_downloads(results: DataFrame, path: str) -> None:
    """Append results (status, ...) to the log at path/log, and keep path/failures at those that failed last."""
    results.write.mode("append").parquet(f"{path}/log")
    replace(results.where("status <> 'ok'"), f"{path}/failures")


def summary_lines(totals: DataFrame, per_category: DataFrame) -> DataFrame:
    """line: a summary's totals (one row) and the documents of each category, in order."""
    head = totals.select(F.explode(F.array(*(F.struct(F.lit(i).alias("n"), F.concat(F.lit(f"Total {c}: "), F.col(c).cast("string")).alias("line")) for i, c in enumerate(totals.columns)))).alias("x")).select("x.n", "x.line")
    rest = per_category.select(F.lit(1000).alias("n"), F.concat(F.lit("  "), "category", F.lit(": "), F.col("documents").cast("string")).alias("line"))
    return head.unionByName(rest).orderBy("n", "line").select("line")

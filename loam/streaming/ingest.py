"""Incremental ingest: a stream of files is checked, deduplicated and upserted into a table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loam.functions.text import dedupe_key


def upsert_batches(stream: DataFrame, table: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Write each batch as a version of its own; read_latest() gives every key's newest row. Replays are harmless.

    Rows without a key are left out. Of a key's rows in one batch that with the smallest text hash stays, and of a text's
    rows (equal up to case and spaces; blank texts aside) that with the smallest key.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.col(key).isNotNull()).withColumn("_hash", F.coalesce(dedupe_key(F.col("text")), F.lit("")))
        one = rows.groupBy(key).agg(F.min(F.struct("_hash", *(c for c in rows.columns if c not in (key, "_hash")))).alias("_r")).select(key, "_r.*")
        blank = F.trim(F.coalesce("text", F.lit(""))) == ""
        first = one.where(~blank).groupBy("_hash").agg(F.min(key).alias(key))
        kept = one.where(~blank).join(first, ["_hash", key], "left_semi").unionByName(one.where(blank))
        kept.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, table: str, key: str = "doc_id") -> DataFrame:
    """Every key's row of the newest batch that has it. The newest is found by a maximum before rows are joined to it."""
    rows = spark.read.option("basePath", table).parquet(f"{table}/batch=*").drop("batch")
    newest = rows.groupBy(key).agg(F.max("_batch").alias("_batch"))
    return rows.join(newest, [key, "_batch"], "left_semi").drop("_batch", "_hash")

"""Streams of manifest records: replay with the last record per key, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.windows import last_per_key


def upsert_stream(changes: DataFrame, table: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Append each batch's last record of every key to ``table``, a Parquet folder with a part for each batch.

    A batch writes its own changes and nothing else; a batch that is run again writes the same part.
    :func:`current` merges the parts, :func:`compact` writes them as one.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        keep = [c for c in batch.columns if c not in keys]
        last_per_key(batch, keys, order, keep).select(*batch.columns).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of every key over all batches; of equal records that of the later batch."""
    rows = spark.read.parquet(table)
    keep = [c for c in rows.columns if c not in (*keys, "batch")]
    return last_per_key(rows, keys, [*order, "batch"], keep)


def compact(spark: SparkSession, table: str, into: str, keys: list[str], order: list[str]) -> None:
    """The current records as the first part of a new table, to which a stream can go on to append."""
    current(spark, table, keys, order).write.mode("errorifexists").parquet(f"{into}/batch=-1")


def windowed_rates(events: DataFrame, at: str, width: str, late: str, group: str, passed) -> DataFrame:
    """Pass rates by time window; records later than ``late`` are left out (batch or stream)."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    g = timed.groupBy(F.window("_at", width).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("k"))
    return g.select(F.col("w.start").alias("window_start"), group, "n", "k")


def first_chunk_latency(chunks: DataFrame, request: str, at: str, kind: str) -> DataFrame:
    """Per request: time to the first chunk, chunks, whether it ended, its last usage."""
    return chunks.groupBy(request).agg(
        (F.min(F.when(F.col(kind) == "audio", F.col(at))) - F.min(at)).alias("first_chunk"),
        F.count_if(F.col(kind) == "audio").alias("chunks"),
        F.bool_or(F.col(kind) == "done").alias("ended"),
        F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col(at))).alias("usage"),
    )

"""Latest queue status per exam, as a stream and as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_status(changes: DataFrame, key: str = "prova_id", at: str = "ts", tiebreak: str = "event_id") -> DataFrame:
    """State after the newest change of each exam. State per key is one small row; use update mode on a stream."""
    return changes.groupBy(key).agg(
        F.max_by("queue_status", F.struct(at, tiebreak)).alias("queue_status"), F.max(at).alias("atualizado"),
        F.count("*").alias("mudancas"))


def version_path(path: str, batch_id: int) -> str:
    return f"{path}/versao-{batch_id}"


def merge_batch(path: str, key: str = "prova_id", at: str = "ts", tiebreak: str = "event_id") -> Callable[[DataFrame, int], None]:
    """Micro-batch writer that keeps one row a key: batch n merges the newest change of each of its keys into version n - 1 and writes
    version n. A batch that runs again starts from the same version and replaces its own, so nothing is counted twice."""

    def run(batch: DataFrame, batch_id: int) -> None:
        last = F.struct(at, tiebreak)
        new = batch.groupBy(key).agg(F.max_by("queue_status", last).alias("queue_status"), F.max(last).alias("ultima"), F.count("*").alias("mudancas"))
        if batch_id:
            new = new.unionByName(batch.sparkSession.read.parquet(version_path(path, batch_id - 1)))
        merged = new.groupBy(key).agg(F.max_by("queue_status", "ultima").alias("queue_status"), F.max("ultima").alias("ultima"), F.sum("mudancas").alias("mudancas"))
        merged.write.mode("overwrite").parquet(version_path(path, batch_id))

    return run


def start_latest_status(changes: DataFrame, path: str, checkpoint: str, **columns: str) -> StreamingQuery:
    """Keep the latest status of every key below `path` while changes arrive; available input is worked off, then the query ends."""
    return (changes.writeStream.outputMode("update").foreachBatch(merge_batch(path, **columns))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_status(spark: SparkSession, query: StreamingQuery, path: str) -> DataFrame:
    """The table after the last micro-batch of a query that has ended: the last one with input wrote the last version."""
    return spark.read.parquet(version_path(path, max(p["batchId"] for p in query.recentProgress if p["numInputRows"])))

"""Streaming: corpora indexed as they arrive, and workers that have gone silent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schemas as S
from quarry.plans import index

TERMINAL = ("failed", "succeeded")


def index_stream(spark: SparkSession, source: str, checkpoint: str, load: Callable[[], index.Index], store: Callable[[index.Index], None], provider, **options):
    """Start a stream that merges each batch of corpus files into the tables. ``load`` and ``store`` read and write the
    tables. All writes replace rows by key, so a batch that is replayed changes nothing. A row without a path marks that
    the batch holds the whole scan of its repository; only then do files that are not in it go."""

    def merge(batch: DataFrame, _: int) -> None:
        scanned = batch.select("repository_id").distinct()
        complete = batch.filter("path IS NULL").select("repository_id").distinct()
        store(index.update(load(), batch.filter("path IS NOT NULL"), scanned, provider, complete=complete, **options))

    stream = spark.readStream.schema(S.CORPUS).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def silent_workers(heartbeats: DataFrame, *, lease_seconds: int = S.LEASE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Of heartbeats (job_id, ts, state), streaming or not: the leases that ended without a terminal state. A session
    closes when no heartbeat has come for the lease time; those later than the watermark are dropped."""
    rows = heartbeats.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if heartbeats.isStreaming else rows
    order = F.struct("ts", F.col("state").isin(*TERMINAL).alias("ended"), "state")  # at one time a terminal state counts as the later
    sessions = rows.groupBy("job_id", F.session_window("ts", f"{lease_seconds} seconds").alias("w")).agg(F.max_by("state", order).alias("last_state"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("heartbeats"))
    return sessions.filter(~F.col("last_state").isin(*TERMINAL)).select("job_id", "last_state", "last_seen", F.col("w.end").alias("expired_at"), "heartbeats")

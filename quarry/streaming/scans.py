"""Scans that arrive over several batches, applied as wholes and once.

The source is a folder of Parquet files with rows of ``SCANS``: a scan's files, in any order and spread over any number of
batches, and one row without a path that says how many files the scan has. State is kept for each repository and scan:
files and bytes counted so far, and the announced number. Once that many have come the scan is complete, and its limits
are those of the whole scan. Only then is it merged: the contents are read from the source again, by the batch that
completes the scan, so they never go through the state, and a repository with a third of all files is a few sums here.

The merge commits the epoch of its batch together with the tables. A batch that is repeated after a failure finds its
epoch committed and changes nothing; one that failed before the commit left nothing to read.

Scans of a repository are applied in the order of their completion; of several that one batch completes, that with the
greatest name. A scan over a limit is not applied. A path that comes twice in a scan stops the job. Rows of a scan that
come after its completion are ignored. Files of the source may go once their scans are complete.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry import schemas as S
from quarry.operators import discover
from quarry.plans import index
from quarry.sources.shared import cut
from quarry.sources.store import Store

SCANS = "repository_id string, scan string, path string, size_bytes long, content binary, files long"
SUMS = "repository_id string, scan string, received long, counted long, bytes long, announced long"
COMPLETE = "repository_id string, scan string, files long, counted long, bytes long, within boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Gathering(StatefulProcessor):
    """Sums of a scan, over batches; a row when the announced number of files has come."""

    def __init__(self, max_files: int, max_bytes: int):
        self.max_files, self.max_bytes = max_files, max_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "received long, counted long, bytes long, announced long, done boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        received, counted, size, announced, done = self.sums.get() if self.sums.exists() else (0, 0, 0, None, False)
        for r in rows:
            received, counted, size = received + r.received, counted + r.counted, size + r.bytes
            announced = r.announced if r.announced is not None else announced
        complete = not done and announced is not None and received >= announced
        self.sums.update((received, counted, size, announced, done or complete))
        if complete:
            within = counted <= self.max_files and size <= self.max_bytes
            yield Row(repository_id=key[0], scan=key[1], files=received, counted=counted, bytes=size, within=within)

    def close(self) -> None:
        pass


def summed(rows: DataFrame, max_file_bytes: int) -> DataFrame:
    """Sums of each task's rows by repository and scan, without an exchange. Files count towards the limits once they
    pass the gates of path and size."""
    gated = discover.sized(discover.classified(rows.select("repository_id", "scan", "path", "size_bytes", "files")), max_file_bytes)
    gated = gated.select("repository_id", "scan", F.col("path").isNotNull().cast("long").alias("received"), F.col("keep").cast("long").alias("counted"), F.when(F.col("keep"), F.col("size_bytes")).alias("bytes"), F.when(F.col("path").isNull(), F.col("files")).alias("announced"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            groups = pdf.fillna({"counted": 0, "bytes": 0}).groupby(["repository_id", "scan"], as_index=False)
            out = groups.agg({"received": "sum", "counted": "sum", "bytes": "sum", "announced": "max"})
            yield out.astype({"counted": "int64", "bytes": "int64", "announced": "Int64"})

    return gated.mapInPandas(run, SUMS)


def completed(rows: DataFrame, *, max_file_bytes: int = S.MAX_FILE_BYTES, max_files: int = S.MAX_REPOSITORY_FILES, max_bytes: int = S.MAX_REPOSITORY_BYTES) -> DataFrame:
    """Of a stream of ``SCANS`` rows: a row for each scan, in the batch that completes it."""
    keyed = summed(rows, max_file_bytes).groupBy("repository_id", "scan")
    return keyed.transformWithState(Gathering(max_files, max_bytes), COMPLETE, "Append", "None")


def merge_scans(store: Store, source: DataFrame, done: DataFrame, provider, *, stream: str, epoch: int, **options) -> None:
    """Apply the complete scans of one batch to the stored tables."""
    if store.done(stream, epoch):
        return
    done = cut(done, "complete-scans")
    taken = done.filter("within").groupBy("repository_id").agg(F.max("scan").alias("scan"))
    rows = source.filter("path IS NOT NULL").join(F.broadcast(taken), ["repository_id", "scan"], "left_semi")  # scans of one batch
    twice = rows.groupBy("repository_id", "path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not twice.isEmpty():
        raise ValueError("a path comes twice in a scan")
    limits = {"max_files": 1 << 40, "max_bytes": 1 << 60}  # those of the whole scan have been applied
    index.update_store(store, rows.select("repository_id", "path", "size_bytes", "content"), taken, provider, complete=taken, stream=stream, epoch=epoch, **options, **limits)


def scan_stream(spark: SparkSession, source: str, checkpoint: str, store: Store, provider, *, stream: str = "scans", max_file_bytes: int = S.MAX_FILE_BYTES, max_files: int = S.MAX_REPOSITORY_FILES, max_bytes: int = S.MAX_REPOSITORY_BYTES, files_per_batch: int | None = None, **options):
    """Start a stream that keeps the stored tables up to date with the scans that arrive in ``source``."""
    reader = spark.readStream.schema(SCANS)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    rows = completed(reader.parquet(source), max_file_bytes=max_file_bytes, max_files=max_files, max_bytes=max_bytes)

    def merge(batch: DataFrame, epoch: int) -> None:
        merge_scans(store, batch.sparkSession.read.schema(SCANS).parquet(source), batch, provider, stream=stream, epoch=epoch, max_file_bytes=max_file_bytes, **options)

    name = "spark.sql.streaming.stateStore.providerClass"  # state by key and by operator needs this one
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        return rows.writeStream.foreachBatch(merge).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)

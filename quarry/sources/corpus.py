"""Corpora, snapshots of tables, and labelled queries."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schemas as S
from quarry.sources.shared import cut


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The packed form: a Parquet table of (repository_id, path, size_bytes, content)."""
    return spark.read.schema(S.CORPUS).parquet(path)


def list_tree(spark: SparkSession, root: str, *, folders_per_task: int = 64, batch_rows: int = 10_000) -> DataFrame:
    """(path, size_bytes) of the regular files below ``root``, a folder that the executors share: no links, all names, in
    the order of the paths' segments. The folders of one depth are listed by tasks, and what they find are the folders of
    the next; the driver only sees how many there are."""
    base = Path(root)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.int64()))], ["path", "folder", "size_bytes"])

        found: list[tuple] = []
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                with os.scandir(base / folder) as entries:
                    for e in entries:
                        path = f"{folder}/{e.name}" if folder else e.name
                        if e.is_dir(follow_symlinks=False):
                            found.append((path, True, 0))
                        elif e.is_file(follow_symlinks=False):
                            found.append((path, False, e.stat(follow_symlinks=False).st_size))
                        if len(found) >= batch_rows:
                            yield batch_of(found)
                            found = []
        if found:
            yield batch_of(found)

    level, count = spark.createDataFrame([("",)], "path string"), 1
    files = spark.createDataFrame([], "path string, size_bytes long")
    while count:
        made = cut(level.repartition(max(1, -(-count // folders_per_task))).mapInArrow(scan, "path string, folder boolean, size_bytes long"), "tree-level")
        files = files.unionByName(made.filter("NOT folder").select("path", "size_bytes"))
        level = made.filter("folder").select("path")
        count = level.count()
    return files.orderBy(F.split("path", "/"))


def read_tree(spark: SparkSession, repository_id: str, root: str, *, files_per_task: int = 256, max_bytes: int = S.MAX_FILE_BYTES) -> DataFrame:
    """A directory on a file system that driver and executors share: regular files, no links, all names. Tasks list the
    folders and read the bytes, and of files over ``max_bytes`` only the size."""
    base = Path(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size_bytes").to_pylist(), strict=True):
                content = (base / path).read_bytes() if size <= max_bytes else b""
                yield pa.RecordBatch.from_arrays([pa.array([repository_id]), pa.array([path]), pa.array([size], pa.int64()), pa.array([content], pa.binary())], names=["repository_id", "path", "size_bytes", "content"])

    listed = cut(list_tree(spark, root), "tree")
    return listed.repartition(max(1, -(-listed.count() // files_per_task))).mapInArrow(read, S.CORPUS)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled queries from JSON lines; blank lines are skipped. The query's text is its id."""
    rows = spark.read.schema(S.LABELED_QUERIES).json(path).filter("query IS NOT NULL")
    return rows.select(F.col("query").alias("query_id"), "query", F.array_distinct("relevant_paths").alias("relevant_paths"))


def write_snapshot(df: DataFrame, table: str, *, buckets: int = 32, key: str = "repository_id") -> str:
    """Write the table as a new snapshot folder below ``table`` and return its path; the old ones stay readable.
    Two writers at once are not supported."""
    path = f"{table.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).write.partitionBy("bucket").parquet(path)
    return path


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, bucket int").parquet(path).drop("bucket")

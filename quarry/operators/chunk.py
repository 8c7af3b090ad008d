"""Chunks: overlapping line windows of files, with their spans and checksums. Built-in expressions and one explode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import schemas as S
from quarry.functions import lines


def chunked(df: DataFrame, text: str = "text", path: str = "path", *, window: int = S.WINDOW_LINES, overlap: int = S.OVERLAP_LINES) -> DataFrame:
    """The other columns of ``df`` with one row per window: chunk_index, start_line, end_line, content, content_sha256.
    A text without lines gives no row."""
    lines.check_window(window, overlap)
    others = [c for c in df.columns if c != text]
    # the array of lines is made once, before the lambda that slices it
    rows = df.withColumn("_lines", lines.lines(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.select(*others, F.inline(lines.windows(F.col("_lines"), window, overlap)))
    return rows.withColumn("content_sha256", lines.chunk_checksum(F.col(path), F.col("start_line"), F.col("end_line"), F.col("content")))


def file_chunks(files: DataFrame, corpus: DataFrame, *, window: int = S.WINDOW_LINES, overlap: int = S.OVERLAP_LINES) -> DataFrame:
    """Chunk rows of inventoried ``files``; paths without a file row are skipped."""
    known = files.select(F.col("id").alias("file_id"), "repository_id", "path")
    texts = corpus.select("repository_id", "path", lines.decoded(F.col("content")).alias("text")).join(known, ["repository_id", "path"])
    out = chunked(texts, window=window, overlap=overlap)
    return out.select(F.sha2(F.concat_ws("\n", "file_id", F.col("chunk_index").cast("string")), 256).alias("id"), "repository_id", "file_id", "chunk_index", "start_line", "end_line", "content", "content_sha256")


def numbered(df: DataFrame, content: str = "content", start: str = "start_line") -> DataFrame:
    """One row per line of a chunk, with its number in the file."""
    others = [c for c in df.columns if c != content]
    return df.select(*others, F.posexplode(F.split(content, "\n")).alias("_at", "line")).withColumn("line_number", F.col(start) + F.col("_at")).drop("_at")

"""Discovery: which files of a corpus are kept, why others are not, and which repositories break a limit.

A corpus has the columns of ``schemas.CORPUS``; further columns are passed through by ``gated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import schemas as S
from quarry.functions import paths


def classified(df: DataFrame, path: str = "path") -> DataFrame:
    """Add keep, reason and language, from the path alone."""
    reason = paths.skip_reason(F.col(path))
    language = F.when(reason.isNull(), paths.language_of(paths.file_name(F.col(path))))
    return df.withColumns({"keep": reason.isNull(), "reason": reason, "language": language})


def sized(df: DataFrame, max_bytes: int = S.MAX_FILE_BYTES) -> DataFrame:
    """After ``classified``: files of more than ``max_bytes`` are out too."""
    large = F.col("keep") & (F.col("size_bytes") > max_bytes)
    return df.withColumns({"reason": F.when(large, "too_large").otherwise(F.col("reason")), "keep": F.col("keep") & ~large})


def sniffed(df: DataFrame, sniff_bytes: int = S.SNIFF_BYTES) -> DataFrame:
    """After ``sized``: binary files are out too. The first step that reads ``content``."""
    binary = F.col("keep") & paths.looks_binary(F.col("content"), sniff_bytes)
    return df.withColumns({"reason": F.when(binary, "binary").otherwise(F.col("reason")), "keep": F.col("keep") & ~binary})


def gated(corpus: DataFrame, *, max_bytes: int = S.MAX_FILE_BYTES, sniff_bytes: int = S.SNIFF_BYTES) -> DataFrame:
    return sniffed(sized(classified(corpus), max_bytes), sniff_bytes)


def skip_report(gated_files: DataFrame) -> DataFrame:
    """Files per repository and reason."""
    return gated_files.filter(~F.col("keep")).groupBy("repository_id", "reason").agg(F.count(F.lit(1)).alias("files"))


def repository_limits(sized_files: DataFrame, *, max_files: int = S.MAX_REPOSITORY_FILES, max_bytes: int = S.MAX_REPOSITORY_BYTES) -> DataFrame:
    """Per repository: counted files and bytes, and ``within``. Files count once they pass the path and size gates."""
    counted = sized_files.filter("keep").groupBy("repository_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
    return counted.withColumn("within", (F.col("files") <= max_files) & (F.col("bytes") <= max_bytes))


def limit_breakers(sized_files: DataFrame, *, max_files: int = S.MAX_REPOSITORY_FILES, max_bytes: int = S.MAX_REPOSITORY_BYTES) -> DataFrame:
    """For each repository over a limit: the first file, in path order, that breaks it, and which limit (files first).

    Only flagged repositories are sorted. A repository within the limits at least holds no more than ``max_files`` rows
    before its breaker, but a flagged one may be large: its rows are first cut to those up to the breaking count.
    """
    flagged = repository_limits(sized_files, max_files=max_files, max_bytes=max_bytes).filter("NOT within").select("repository_id")
    rows = sized_files.filter("keep").select("repository_id", "path", "size_bytes").join(flagged, "repository_id", "left_semi")
    order = Window.partitionBy("repository_id").orderBy(F.split("path", "/"))
    first = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= max_files + 1)  # the count breaks here at the latest
    running = first.withColumn("running_bytes", F.sum("size_bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    limit = F.when(F.col("nth") > max_files, "files").when(F.col("running_bytes") > max_bytes, "bytes")
    broken = running.withColumn("broken", limit).filter("broken IS NOT NULL")
    return broken.groupBy("repository_id").agg(F.min_by(F.struct("path", "broken", "nth", "running_bytes"), "nth").alias("x")).select("repository_id", "x.*")


def file_id(repository: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", repository, path), 256)


def inventory(kept: DataFrame) -> DataFrame:
    """One metadata row per kept file."""
    return kept.select(file_id(F.col("repository_id"), F.col("path")).alias("id"), "repository_id", "path", "language", "size_bytes", F.sha2("content", 256).alias("checksum_sha256"))

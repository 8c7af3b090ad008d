"""Tables laid out for lookups by key: files hold narrow ranges of the key, and each row group has a Bloom filter of it.

The rows are ranged and sorted by the key when they are written. A lookup names its keys in the scan's filter, so row
groups whose range or Bloom filter rules the keys out are not read. More keys than ``max_keys`` take a join, as then most
row groups are needed anyway.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, key: str, *, files: int | None = None, row_group_bytes: int = 8 << 20, keys_per_group: int = 1 << 20) -> None:
    """Write ``df`` sorted by ``key``, a string or a number."""
    ranged = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    writer = ranged.sortWithinPartitions(key).write.option("parquet.block.size", row_group_bytes)
    writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", keys_per_group).parquet(path)


def look_up(spark: SparkSession, path: str, keys: DataFrame, key: str, *, max_keys: int = 1000) -> DataFrame:
    """The stored rows whose ``key`` is among ``keys``."""
    asked = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    some = [r[0] for r in asked.limit(max_keys + 1).collect()]
    stored = spark.read.parquet(path)
    if len(some) > max_keys:
        return stored.join(asked, key, "left_semi").select(*stored.columns)
    if not some:
        return stored.limit(0)
    # one comparison per key reaches the files, where a list of many would only be its range
    terms = [F.col(key) == k for k in sorted(some)]
    while len(terms) > 1:  # a balanced tree
        terms = [reduce(or_, terms[i : i + 2]) for i in range(0, len(terms), 2)]
    return stored.filter(terms[0])

"""Catalog tables in buckets of their merge key, so that a merge exchanges the new rows only.

A table is kept as numbered generations (``name_0``, ``name_1`` ...), each bucketed and sorted by the key, and a view
``name`` on the last one. A merge reads the stored side bucket by bucket, without an exchange and without a sort, writes
the next generation, whose rows are in their buckets already, and then points the view at it. The last generations stay
for readers that began before; ``keep`` says how many.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def generations(spark: SparkSession, name: str) -> list[int]:
    found = [re.fullmatch(re.escape(name.lower()) + r"_(\d+)", t.name) for t in spark.catalog.listTables()]
    return sorted(int(m.group(1)) for m in found if m)


def save(df: DataFrame, name: str, keys: list[str], *, buckets: int = 64, keep: int = 2) -> str:
    """Store ``df`` as the next generation of ``name`` and point the view at it. Returns the generation's table name."""
    spark = df.sparkSession
    old = generations(spark, name)
    made = f"{name}_{old[-1] + 1 if old else 0}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(made)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {made}")
    for g in old[: max(0, len(old) + 1 - keep)]:
        spark.sql(f"DROP TABLE {name}_{g}")
    return made


def merge(spark: SparkSession, name: str, new: DataFrame, keys: list[str], how: Callable[[DataFrame, DataFrame], DataFrame], *, buckets: int = 64, keep: int = 2) -> str:
    """Store ``how(stored, new)`` as the next generation: a keyed join such as ``tables.upsert_files``."""
    return save(how(spark.table(name), new), name, keys, buckets=buckets, keep=keep)

"""Exact deduplication as a tree-merge of sorted digest runs, in DataFrame operations only.

Every row gives one narrow record: a SHA-256 digest of the normalised text, and its length and a second hash of
another family, which verify each digest match. The records form ``runs`` runs by a hash of the identifier. A run is
sorted by digest and holds one record per text. Round by round, ``fan_in`` neighbouring runs are merged (the binomial
exchange, with more than two partners): the merge sorts by digest, keeps the smallest (or largest) identifier among
verified equals and adds up their counts. After ceil(log(runs, fan_in)) rounds one record per text is left, spread
over all partitions by digest. A text with a third of all rows is at most ``runs`` records after the first step,
so no task ever meets its rows together. Only records move along the tree; ``drop_copies`` then shuffles the texts once,
``assign`` once more by their key where the table of records is too large to be sent to every task. Digests of very long
texts take time in proportion to their bytes.

Defined cases: a null text counts as empty; empty texts equal each other; rows with a null identifier belong to their
text's group but never name it unless all are null; a row that is repeated whole gets the same answer each time
(``drop_copies`` leaves one of them); an empty table gives an empty result; other columns are ignored by ``groups`` and
``assign`` and passed through by ``drop_copies``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, cut, text_or_empty

KEY = ["_xd_digest", "_xd_length", "_xd_check"]


def with_key(df: DataFrame, text_col: str = "text", fold: bool = True) -> DataFrame:
    """Add the digest of the normalised text (``fold``: A-Z in lower case) and the two values that verify it."""
    normal = ascii_lower(text_or_empty(text_col)) if fold else text_or_empty(text_col)
    return df.withColumns({"_xd_digest": F.unhex(F.sha2(normal, 256)), "_xd_length": F.octet_length(normal), "_xd_check": F.xxhash64(normal)})


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "smallest", runs: int = 64, fan_in: int = 8, carry: dict | None = None, fold: bool = True) -> DataFrame:
    """One record per distinct text: the key columns, ``_xd_keep`` and ``_xd_n``.

    ``carry`` names further aggregates to merge along the tree: name -> (column of ``df``, associative function).
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    if runs < 1 or fan_in < 2:
        raise ValueError("runs must be at least 1 and fan_in at least 2")
    carry = carry or {}
    pick = F.min if keep == "smallest" else F.max
    last = F.col(id_col).isNull() if keep == "smallest" else F.col(id_col).isNotNull()  # null identifiers come last
    rows = with_key(df, text_col, fold).select(
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(runs)).alias("_xd_run"),
        *KEY,
        F.struct(last.alias("last"), F.col(id_col).alias("id")).alias("_xd_best"),
        F.lit(1).cast("long").alias("_xd_n"),
        *[F.col(c).alias(name) for name, (c, _) in carry.items()],
    )

    def merged(x: DataFrame, keys: list[str]) -> DataFrame:
        # min and max of a struct make Spark sort by the keys and merge neighbours, in memory that does not grow with the run
        return x.groupBy(*keys, *KEY).agg(pick("_xd_best").alias("_xd_best"), F.sum("_xd_n").alias("_xd_n"), *[f(name).alias(name) for name, (_, f) in carry.items()])

    out, left = merged(rows, ["_xd_run"]), runs
    while left > fan_in:
        left = -(-left // fan_in)
        out = merged(out.withColumn("_xd_run", F.floor(F.col("_xd_run") / fan_in)), ["_xd_run"])
    return merged(out.drop("_xd_run"), []).select(*KEY, F.col("_xd_best.id").alias("_xd_keep"), "_xd_n", *carry)


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, fold: bool = True, **options) -> DataFrame:
    """``df`` with the key columns, ``_xd_keep``, ``_xd_n`` and ``_xd_kept``, one row per row of ``df``."""
    table = cut(groups(df, id_col, text_col, fold=fold, **options), "digest-groups")
    return with_key(df, text_col, fold).join(table, KEY, "left").withColumn("_xd_kept", F.col(id_col).eqNullSafe(F.col("_xd_keep")))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "smallest", runs: int = 64, fan_in: int = 8) -> DataFrame:
    """The rows of ``df`` that stay, with its own columns: one per distinct text."""
    tag = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), c.cast("string")))
    table = groups(df, id_col, text_col, keep=keep, runs=runs, fan_in=fan_in).select(*KEY, tag(F.col("_xd_keep")).alias("_xd_id"))
    keyed = with_key(df, text_col).withColumn("_xd_id", tag(F.col(id_col)))
    # one shuffle serves the join and the last step; the keepers grow with the input, so they are never broadcast
    kept = keyed.join(cut(table, "digest-keepers").hint("merge"), [*KEY, "_xd_id"], "left_semi")
    return kept.dropDuplicates([*KEY, "_xd_id"]).select(*[kept[f"`{c}`"] for c in df.columns])

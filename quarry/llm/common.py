"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.sources.shared import cut, shared_folder

__all__ = ["SPACE", "SPACE_CHARS", "ascii_lower", "count_chars", "cut", "dropped", "restricted", "shared_folder", "text_or_empty", "words"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space that separates words: the space and U+0009 to U+000D.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. ``lower`` is the faster way for texts that are all ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def words(text: Column) -> Column:
    """The maximal runs of characters other than white space, in order."""
    split = F.split(F.btrim(text, F.lit(SPACE_CHARS)), f"[{SPACE}]+")  # of an empty text: one empty word
    return F.array_remove(split, "")


def _few(keys: DataFrame, max_rows: int) -> bool:
    return keys.limit(max_rows + 1).count() <= max_rows


def restricted(df: DataFrame, keys: DataFrame, on: str, *, max_rows: int = 1 << 20) -> DataFrame:
    """The rows of ``df`` whose ``on`` is in ``keys`` (``on``; written, distinct, a number). The keys go to every task
    where they are at most ``max_rows``, so that ``df`` stays where it is; else both sides are shuffled."""
    return df.join(keys.hint("broadcast" if _few(keys, max_rows) else "merge"), on, "left_semi")


def dropped(df: DataFrame, ids: DataFrame, id_col: str, *, max_rows: int = 1 << 20) -> DataFrame:
    """The rows of ``df`` whose identifier is not in ``ids`` (id; written, distinct); null is an identifier like any
    other. Broadcast or shuffled as in ``restricted``."""
    gone = ids.select(F.col("id").alias("_gone_id")).hint("broadcast" if _few(ids, max_rows) else "merge")
    return df.join(gone, F.col(id_col).eqNullSafe(F.col("_gone_id")), "left_anti")

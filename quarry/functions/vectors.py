"""Vectors in array columns; all sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """Scaled to length one; a zero vector stays zero."""
    length = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(length == 0, F.lit(1.0)).otherwise(length))


def cosine(a: Column, b: Column) -> Column:
    """From -1 to 1; null where either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def checked_width(v: Column, dim: int) -> Column:
    """The vector itself; a vector of another width stops the job."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"expected a vector of width {dim}, got "), F.size(v).cast("string"))))


def hash_components(text: Column, dim: int) -> Column:
    """Components of the hash embedding before scaling: two bytes each of the SHA-256 digests of "0:text", "1:text"..."""
    digests = [F.sha2(F.concat(F.lit(f"{i}:"), text), 256) for i in range(-(-dim // 16))]
    pairs = F.regexp_extract_all(F.concat(*digests), F.lit("[0-9a-f]{4}"), F.lit(0))
    return F.transform(F.slice(pairs, 1, dim), lambda h: F.conv(h, 16, 10).cast("double") / 65535 - 0.5)

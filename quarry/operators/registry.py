"""Registration of repositories and users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import links

KEY = ["owner_id", "provider", "owner_name", "repo_name"]


def parsed(df: DataFrame, url: str = "url") -> DataFrame:
    """Add provider, owner_name, repo_name, clone_url and the reason of a rejection."""
    return df.withColumn("_parsed", links.parsed_url(F.col(url))).select(*df.columns, "_parsed.*")


def registered(requests: DataFrame, repositories: DataFrame, order: str = "request_id") -> DataFrame:
    """``requests`` (request_id, owner_id, url) with ``result``: invalid, conflict or created. Of equal requests the
    first is created; the same repository under another owner is no conflict."""
    rows = parsed(requests)
    there = repositories.select(*KEY).distinct().withColumn("_there", F.lit(True))
    first = rows.filter("reason IS NULL").groupBy(*KEY).agg(F.min(order).alias("_first"))  # combined before the shuffle
    rows = rows.join(first, KEY, "left").join(there, KEY, "left")
    result = F.when(F.col("reason").isNotNull(), "invalid").when(F.col("_there") | (F.col(order) > F.col("_first")), "conflict").otherwise("created")
    return rows.withColumn("result", result).drop("_first", "_there")


def same_email(users: DataFrame, emails: DataFrame) -> DataFrame:
    """Users by mail address, whatever its case and surrounding space."""
    asked = emails.select(links.normal_email(F.col("email")).alias("_email")).distinct()
    return users.withColumn("_email", links.normal_email(F.col("email"))).join(asked, "_email", "left_semi").drop("_email")

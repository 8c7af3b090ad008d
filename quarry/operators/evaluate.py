"""Retrieval quality: recall at k and mean reciprocal rank over labelled queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry import schemas as S


def ranked_paths(ranked: DataFrame) -> DataFrame:
    """Of ranked chunks (query_id, path, rank): the distinct paths of each query, ranked by their best chunk."""
    firsts = ranked.filter(F.col("rank") <= max(S.EVAL_K)).groupBy("query_id", "path").agg(F.min("rank").alias("chunk_rank"))
    return firsts.withColumn("path_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_rank")))


def metrics(labelled: DataFrame, ranked: DataFrame, ks: tuple[int, ...] = S.EVAL_K) -> DataFrame:
    """One row: n_queries, recall_at_k for each k, mrr. ``labelled``: (query_id, relevant_paths); every query counts,
    also without a hit. No query at all stops the job."""
    relevant = labelled.select("query_id", F.explode(F.array_distinct("relevant_paths")).alias("path"))
    first = ranked_paths(ranked).join(relevant, ["query_id", "path"]).groupBy("query_id").agg(F.min("path_rank").alias("first"))
    every = labelled.select("query_id").distinct().join(first, "query_id", "left")
    recalls = [F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in ks]
    out = every.agg(F.count(F.lit(1)).alias("n_queries"), *recalls, F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))
    return out.withColumn("mrr", F.when(F.col("n_queries") > 0, F.col("mrr")).otherwise(F.raise_error(F.lit("no labelled queries")).cast("double")))


def require_vectors(embeddings: DataFrame, repository_id: str) -> None:
    """Refuse to measure a repository without vectors."""
    if embeddings.filter(F.col("repository_id") == repository_id).isEmpty():
        raise ValueError("the repository has no embeddings; index it first")

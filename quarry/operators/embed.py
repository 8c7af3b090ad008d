"""Embedding providers. A provider turns texts into unit vectors of one width; ``embed`` runs it over a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import schemas as S
from quarry.functions import vectors
from quarry.sources.shared import cut

#: Vectors by model and SHA-256 of the text.
CONTENTS = "key string, model string, dim int, embedding array<float>"


class Provider(Protocol):
    model_name: str
    dim: int

    def column(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """``df`` with the vectors of its texts."""


class HashProvider:
    """Vectors from SHA-256 digests: equal texts, equal vectors. Built-in expressions only."""

    def __init__(self, dim: int = S.EMBEDDING_DIM):
        self.model_name, self.dim = "hash", dim

    def vector(self, text: Column) -> Column:
        return vectors.hash_components(text, self.dim)

    def column(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn("_components", self.vector(F.col(text))).withColumn(out, vectors.normalised(F.col("_components")).cast("array<float>")).drop("_components")


class ModelProvider:
    """Vectors of a user's model: ``load()`` gives a function from a list of texts to a list of vectors. It is called
    once per Python worker, on first use; texts come in batches of ``batch_size`` across rows of a task."""

    def __init__(self, model_name: str, dim: int, load: Callable[[], Callable[[list[str]], list]], batch_size: int = S.EMBEDDING_BATCH):
        self.model_name, self.dim, self.load, self.batch_size = model_name, dim, load, batch_size

    def column(self, df: DataFrame, text: str, out: str) -> DataFrame:
        load, size = self.load, self.batch_size
        kept = [c for c in df.columns if c != out]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = None
            for pdf in batches:
                found: list = []
                texts = pdf[text].tolist()
                for lo in range(0, len(texts), size):
                    model = model or load()
                    found += [[float(x) for x in v] for v in model(texts[lo : lo + size])]
                pdf[out] = found
                yield pdf

        schema = S.struct(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields) + f", `{out}` array<double>")
        made = df.select(*kept).mapInPandas(run, schema)
        checked = made.withColumn(out, vectors.checked_width(F.col(out), self.dim))
        return checked.withColumn(out, vectors.normalised(F.col(out)).cast("array<float>"))


def provider(name: str, dim: int = S.EMBEDDING_DIM, **options) -> Provider:
    """By name: ``hash``, or ``model`` with the options of ``ModelProvider``."""
    if name == "hash":
        return HashProvider(dim)
    if name == "model":
        return ModelProvider(options.pop("model_name", "model"), dim, **options)
    raise ValueError(f"unknown embedding provider: {name}")


def embed(chunks: DataFrame, using: Provider) -> DataFrame:
    """Embedding rows of chunk rows."""
    made = using.column(chunks.select(F.col("id").alias("chunk_id"), "repository_id", "content"), "content", "embedding")
    return made.select("chunk_id", "repository_id", F.lit(using.model_name).alias("model"), F.lit(using.dim).alias("dim"), "embedding")


def length_classes(text: Column) -> Column:
    """A text's length, rounded so that there are 16 classes from each power of two to the next."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    unit = F.greatest(F.pow(F.lit(2.0), F.floor(F.log2(n)) - 4), F.lit(1.0))
    return (F.floor(n / unit) * unit).cast("long")


def balanced(df: DataFrame, text: str, key: str, tasks: int | None = None) -> DataFrame:
    """``df`` dealt over tasks with near equal sums of text lengths, and texts of near equal length together: the sums of
    the length classes, one after the other, are cut into ``tasks`` equal shares, and a class that lies across a cut
    is dealt by a hash of ``key`` in the shares' proportion. A text longer than a share is a task's largest part."""
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_class", length_classes(F.coalesce(F.col(text), F.lit(""))))
    sums = {r["_class"]: r["n"] for r in rows.groupBy("_class").agg((F.count(F.lit(1)) * F.col("_class")).alias("n")).collect()}  # some 16 a power of two
    total, before, places = sum(sums.values()), 0, []
    for c in sorted(sums):
        places += [F.lit(c).cast("long"), F.struct(F.lit(before / total), F.lit(sums[c] / total))]
        before += sums[c]
    if not places:
        return df
    share = F.element_at(F.create_map(*places), F.col("_class"))
    even = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / (1 << 30)
    task = F.least(F.floor((share["col1"] + share["col2"] * even) * tasks), F.lit(tasks - 1)).cast("int")
    return rows.withColumn("_task", task).repartitionById(tasks, "_task").sortWithinPartitions("_class", key).drop("_class", "_task")


def embed_new(chunks: DataFrame, using: Provider, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Embedding rows of written ``chunks`` (id, repository_id, content; other columns are kept), and the rows that the
    store of vectors by content (``CONTENTS``) lacked. A text that is in many chunks is embedded once, one whose vector is
    known not at all."""
    keyed = chunks.withColumn("key", F.sha2("content", 256))
    have = known.filter((F.col("model") == using.model_name) & (F.col("dim") == using.dim)).select("key", "embedding")
    texts = keyed.groupBy("key").agg(F.min("content").alias("content"))
    misses = cut(texts.join(have, "key", "left_anti"), "new-contents")
    made = using.column(balanced(misses, "content", "key"), "content", "embedding").select("key", "embedding")
    made = cut(made, "new-vectors")
    # both sides are read from files, so a text that is in very many chunks can be split
    found = keyed.drop("content").join(have.join(keyed.select("key").distinct(), "key", "left_semi").unionByName(made), "key")
    model = {"model": F.lit(using.model_name), "dim": F.lit(using.dim)}
    others = [c for c in chunks.columns if c not in ("id", "content")]
    return found.withColumns(model).select(F.col("id").alias("chunk_id"), *others, "model", "dim", "embedding"), made.withColumns(model)

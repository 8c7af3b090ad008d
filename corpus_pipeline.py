"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``documents``; the last returns the
pieces of the packed sequences. ``run`` writes each stage's result as Parquet to the shared folder and reads it back.

Defined cases: null and empty texts, and those under fifty words, go with the quality rules; nulls in other columns change
nothing but that a null source is one of its own in the mix; rows with equal texts, repeated rows included, leave one, and
one with an identifier where there is any; rows without an identifier are kept like others; very long texts are whole
throughout and are cut into pieces at the end only; an empty table gives an empty result; further columns, whatever their
names, are carried up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, mixing, packing, quality, simhash
from quarry.llm.common import cut
from quarry.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest identifier stays."""
    return exact_dedup.drop_copies(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest identifier stays. Near means that two texts share
    0.8 or more of their five-word shingles."""
    return simhash.drop_similar(docs, width=5, threshold=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens; ``row`` tells the copies of a document apart."""
    parts = cut(packing.pieces(docs, vocabulary()), "pieces")
    return packing.pack(parts).select(F.col("id").alias("doc_id"), "row", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has neither components of similar texts nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

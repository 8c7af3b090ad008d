"""A stored vector index: unit vectors in folders by cell, read through partition pruning, which grows by appends.

The centres are about the square root of the rows in number and are fitted on two levels. The upper level, about the
square root of the centres, comes from a bounded sample on the driver. The lower level is fitted in tasks, one for each
upper group, on a bounded sample of the group. Every vector is then stored once, in the folder of its cell: the nearest
centre of its nearest group. To find it, the centres of a group travel ahead of the group's vectors in the one exchange
that also brings the vectors together by cell; a group with many rows is dealt over several tasks.

A search reads the folders of each query's nearest cells only, and scores what it reads exactly. How many cells that
takes depends on the vectors, so the build measures it: some stored vectors are searched exactly and by cells, and the
least number of cells that reaches the target recall is written down with the index (``calibration``).

Folders below ``path``: ``groups``, ``centres``, ``calibration``, and ``vectors/batch=.../cell=...``. An append writes a
batch of its own; when it is repeated, it replaces itself. ``remove`` rewrites only the cells that hold one of the ids.
One writer at a time; readers that began before ``remove`` may have to begin again.

Defined cases: vectors of length zero are stored in the cell that comes first and get a null score; equal vectors share a
cell, which may then hold any share of the rows; an empty table makes an index without cells, which finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quarry import schemas as S
from quarry.functions import vectors
from quarry.operators import search as exact
from quarry.sources.shared import cut

CENTRES, GROUPS, CALIBRATION = "group int, cell int, centre array<float>", "group int, share double, centre array<float>", "probes int, recall double, ids string"


def unit_means(v: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """At most ``k`` different unit centres of unit vectors: k-means by the cosine; an empty cell starts again at the
    vector that is farthest from its centre."""
    rng = np.random.default_rng(seed)
    v = v.astype(np.float64)
    centres = v[rng.choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(rounds):
        near = v @ centres.T
        cell = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, v)
        empty = np.flatnonzero(np.bincount(cell, minlength=len(centres)) == 0)
        sums[empty] = v[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = sums / np.where(length > 0, length, 1)
    return np.unique(centres.astype(np.float32), axis=0)


def _unit_rows(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("chunk_id", "repository_id", vectors.normalised(F.col("embedding")).cast("array<float>").alias("embedding"))


def _sample(rows: DataFrame, n: int, most: int, seed: int) -> DataFrame:
    """About ``most`` of n rows, by a hash of their id."""
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def _grouped(rows: DataFrame, upper: np.ndarray) -> DataFrame:
    """Add ``group``, the number of the nearest upper centre."""

    @F.pandas_udf("int")
    def nearest(column: pd.Series) -> pd.Series:
        return pd.Series((np.stack(column.to_numpy()) @ upper.T).argmax(axis=1).astype(np.int32)) if len(column) else pd.Series([], dtype="int32")

    return rows.withColumn("group", nearest("embedding"))


def build(embeddings: DataFrame, path: str, *, n_cells: int | None = None, sample_rows: int = 20_000, per_cell: int = 32, max_group_cells: int = 1024, seed: int = 7, recall: float = 0.95, k: int = S.TOP_K_DEFAULT, calibration_queries: int = 200) -> None:
    """Fit, store and calibrate an index of all ``embeddings`` (chunk_id, repository_id, embedding)."""
    spark, rows = embeddings.sparkSession, _unit_rows(embeddings)
    n = rows.count()
    cells = n_cells or math.ceil(math.sqrt(n))
    found: list[tuple] = []
    centres = spark.createDataFrame([], CENTRES)
    if n:
        upper = unit_means(np.array([r[0] for r in _sample(rows, n, sample_rows, seed).select("embedding").collect()] or [rows.first()["embedding"]], np.float32), math.ceil(math.sqrt(cells)), seed)
        sample = cut(_grouped(_sample(rows, n, per_cell * cells, seed + 1), upper), "index-sample")
        counts = {r["group"]: r["n"] for r in sample.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
        total = max(1, sum(counts.values()))
        found = [(g, counts.get(g, 0) / total, [float(x) for x in c]) for g, c in enumerate(upper)]
        want = {g: max(1, min(max_group_cells, round(cells * m / total))) for g, m in counts.items()}
        share = F.create_map(*[F.lit(x) for g, m in counts.items() for x in (g, min(1.0, max_group_cells * per_cell / m))]) if counts else F.create_map(F.lit(0), F.lit(1.0))
        some = sample.filter(F.pmod(F.xxhash64("chunk_id", F.lit(seed + 2)), F.lit(1 << 30)) < F.element_at(share, F.col("group")) * (1 << 30))

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            g = int(pdf["group"].iloc[0])
            own = unit_means(np.stack(pdf["embedding"].to_numpy()), want[g], seed + g)
            return pd.DataFrame({"group": g, "cell": np.arange(len(own)) + g * max_group_cells, "centre": [x.tolist() for x in own]})

        centres = some.select("group", "embedding").groupBy("group").applyInPandas(fit, CENTRES)
        # a group that no sampled row is in has its own centre as its only cell
        bare = [(g, g * max_group_cells, c) for g, s, c in found if not s]
        centres = centres.unionByName(spark.createDataFrame(bare, CENTRES))
    spark.createDataFrame(found, GROUPS).coalesce(1).write.mode("overwrite").parquet(f"{path}/groups")
    centres.write.mode("overwrite").parquet(f"{path}/centres")
    _note(spark, path, 1, 1.0, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("chunk_id", "repository_id")))
    _placed(assigned(rows, path, n) if n else rows.withColumn("cell", F.lit(0)), path, "base", whole=True)
    if n:
        _calibrate(spark, path, n, recall, k, calibration_queries, seed)


def assigned(rows: DataFrame, path: str, n: int, rows_per_task: int = 100_000) -> DataFrame:
    """``rows`` with ``cell``: the centres of each group come first, then the group's vectors, in one stream."""
    spark = rows.sparkSession
    groups = spark.read.schema(GROUPS).parquet(f"{path}/groups").orderBy("group").collect()  # the square root of the cells
    tasks = F.element_at(F.create_map(*[F.lit(x) for r in groups for x in (r["group"], max(1, math.ceil(n * r["share"] / rows_per_task)))]), F.col("group"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    own = _grouped(rows, np.array([r["centre"] for r in groups], np.float32)).withColumn("part", F.pmod(F.xxhash64("chunk_id"), tasks).cast("int"))
    ahead = spark.read.schema(CENTRES).parquet(f"{path}/centres").withColumn("part", F.explode(F.sequence(F.lit(0), tasks - 1)))
    ahead = ahead.select("group", "part", "cell", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("chunk_id", "repository_id")], F.col("centre").alias("embedding"))
    both = ahead.unionByName(own.withColumn("cell", F.lit(None).cast("int")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, cells, table = None, [], []
        for pdf in batches:
            pdf["ahead"] = pdf["cell"].notna()
            for here, part in pdf.groupby(["group", "part", "ahead"], sort=False):
                if here[:2] != key:
                    key, cells, table = here[:2], [], []
                if here[2]:
                    cells += part["cell"].astype(int).tolist()
                    table += part["embedding"].tolist()
                else:
                    near = np.stack(part["embedding"].to_numpy()) @ np.array(table, np.float32).T
                    yield part[["chunk_id", "repository_id", "embedding"]].assign(cell=np.array(cells, np.int32)[near.argmax(axis=1)])

    met = both.repartition("group", "part").sortWithinPartitions("group", "part", F.desc(F.col("cell").isNotNull()), "cell")
    return met.mapInPandas(run, f"chunk_id {kinds['chunk_id']}, repository_id {kinds['repository_id']}, embedding array<float>, cell int")


def _placed(rows: DataFrame, path: str, batch: str, whole: bool = False) -> None:
    made = rows.withColumn("batch", F.lit(batch))
    made.write.mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic").partitionBy("batch", "cell").parquet(f"{path}/vectors")


def _note(spark: SparkSession, path: str, probes: int, recall: float, ids: str) -> None:
    spark.createDataFrame([(probes, recall, ids)], CALIBRATION).coalesce(1).write.mode("overwrite").parquet(f"{path}/calibration")


def calibration(spark: SparkSession, path: str) -> Row:
    """What the build measured: ``probes`` cells reach ``recall``. ``ids`` are the types of the ids."""
    return spark.read.schema(CALIBRATION).parquet(f"{path}/calibration").first()


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All stored rows: chunk_id, repository_id, embedding, batch, cell."""
    return spark.read.schema(f"{calibration(spark, path)['ids']}, embedding array<float>, batch string, cell int").parquet(f"{path}/vectors")


def append(embeddings: DataFrame, path: str, batch: str) -> None:
    """Store more rows in the cells there are. A batch that is appended again under its name replaces itself; ``base`` is
    the build's."""
    if not batch.isalnum() or batch == "base":
        raise ValueError("a batch is named by letters and digits, and 'base' is the build's own")
    spark, rows = embeddings.sparkSession, cut(_unit_rows(embeddings), "appended")
    n = rows.count()
    if spark.read.schema(GROUPS).parquet(f"{path}/groups").isEmpty():
        raise ValueError("an index without cells cannot grow: build it")
    if n:
        _placed(cut(assigned(rows, path, n), "placed"), path, batch)
    # rows of an earlier form of the batch, in cells that the new one does not touch
    gone = stored(spark, path).filter(F.col("batch") == batch).join(rows.select("chunk_id"), "chunk_id", "left_anti")
    remove(spark, path, gone, batch=batch)


def remove(spark: SparkSession, path: str, ids: DataFrame, *, batch: str | None = None) -> int:
    """Take the rows with these chunk ids out; only the folders that hold one are rewritten. Returns how
    many those were."""
    gone = cut(ids.select("chunk_id").distinct(), "removed-ids")
    rows = stored(spark, path) if batch is None else stored(spark, path).filter(F.col("batch") == batch)
    hit = rows.join(gone, "chunk_id", "left_semi").select("batch", "cell").distinct().collect()  # folders
    if not hit:
        return 0
    by: dict[str, list[int]] = {}
    for r in hit:
        by.setdefault(r["batch"], []).append(r["cell"])
    touched = rows.filter(" OR ".join(f"(batch = '{b}' AND cell IN ({', '.join(map(str, sorted(c)))}))" for b, c in by.items()))
    left = cut(touched.join(gone, "chunk_id", "left_anti").select(*rows.columns), "remaining")
    full = {(r["batch"], r["cell"]) for r in left.select("batch", "cell").distinct().collect()}
    left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "cell").parquet(f"{path}/vectors")
    jvm = spark.sparkContext._jvm
    for r in hit:
        if (r["batch"], r["cell"]) not in full:  # nothing is left in the folder
            folder = jvm.org.apache.hadoop.fs.Path(f"{path}/vectors/batch={r['batch']}/cell={r['cell']}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return len(hit)


def probed(spark: SparkSession, path: str, queries: DataFrame, probes: int, max_query_bytes: int = 64 << 20) -> DataFrame:
    """(query_id, cell, rank): the nearest ``probes`` cells of each query (query_id, vector)."""
    centres = spark.read.schema(CENTRES).parquet(f"{path}/centres").select(F.lit(0).alias("all"), F.col("cell").alias("chunk_id"), F.col("centre").alias("embedding"))
    found = exact.products(centres, queries.select("query_id", F.lit(0).alias("all"), "vector"), probes, within="all", max_query_bytes=max_query_bytes)
    return exact.best(found, probes).select("query_id", F.col("chunk_id").alias("cell"), "rank")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = S.TOP_K_DEFAULT, *, probes: int | None = None, scoped: bool = False, max_query_bytes: int = 64 << 20, max_named_cells: int = 20_000) -> DataFrame:
    """Approximate ``search_blocks``: query_id, chunk_id, score, rank of ``queries`` (query_id, vector, and with ``scoped``
    repository_id, whose vectors alone are then searched). Only the folders of probed cells are read."""
    near = cut(probed(spark, path, queries, probes or calibration(spark, path)["probes"], max_query_bytes), "probed")
    cells = near.select("cell").distinct()
    rows = stored(spark, path)
    if cells.count() <= max_named_cells:  # else nearly all folders are read anyway
        rows = rows.filter(F.col("cell").isin([r["cell"] for r in cells.collect()]))
    keys = ["cell", "repository_id"] if scoped else ["cell"]
    asked = near.select("query_id", "cell").join(queries, "query_id").select("query_id", F.concat_ws("\n", *keys).alias("place"), "vector")
    found = exact.products(rows.withColumn("place", F.concat_ws("\n", *keys)), asked, k, within="place", max_query_bytes=max_query_bytes)
    return exact.best(found, k)


def _calibrate(spark: SparkSession, path: str, n: int, recall: float, k: int, most: int, seed: int) -> None:
    """Write the least number of cells at which the exact neighbours of a bounded sample of rows are read, as far as the
    target asks. The sampled rows themselves do not count as their own neighbours."""
    rows = stored(spark, path)
    asked = cut(_sample(rows, n, most, seed + 3).select(F.col("chunk_id").alias("query_id"), F.lit(0).alias("all"), F.col("embedding").alias("vector")), "calibration-queries")
    near = exact.best(exact.products(rows.withColumn("all", F.lit(0)), asked, k + 1, within="all"), k + 1).filter("query_id != chunk_id").select("query_id", "chunk_id")
    near = cut(near, "calibration-neighbours")
    cells = cut(probed(spark, path, asked, spark.read.parquet(f"{path}/centres").count()), "calibration-cells")
    held = rows.join(F.broadcast(near.select("chunk_id").distinct()), "chunk_id", "left_semi").select("chunk_id", "cell")  # at most k per sampled row
    ranks = near.join(held, "chunk_id").join(cells, ["query_id", "cell"]).groupBy("rank").agg(F.count(F.lit(1)).alias("n")).orderBy("rank").collect()
    total, so_far, made = sum(r["n"] for r in ranks), 0, (1, 1.0)
    for r in ranks:
        so_far += r["n"]
        made = (r["rank"], so_far / total)
        if so_far >= recall * total:
            break
    _note(spark, path, *made, calibration(spark, path)["ids"])

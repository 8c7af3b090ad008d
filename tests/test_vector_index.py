import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import search, vector_index

SCHEMA = "chunk_id long, repository_id string, embedding array<float>"


def clustered(n, themes, dim=32, seed=0):
    """Vectors by theme and, within it, by subject of about 25 vectors, with noise."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(themes, dim))
    subjects = max(1, n // 25)
    subject = middle[rng.integers(0, themes, subjects)] + 0.5 * rng.normal(size=(subjects, dim))
    return subject[rng.integers(0, subjects, n)] + 0.25 * rng.normal(size=(n, dim))


def table(spark, v, first=0):
    import pandas as pd

    made = pd.DataFrame({"chunk_id": np.arange(len(v)) + first, "repository_id": [f"r{i % 3}" for i in range(len(v))], "embedding": [x.astype(np.float32).tolist() for x in v]})
    return spark.createDataFrame(made, SCHEMA)


def queries_of(rows, every=50):
    return rows.filter(f"chunk_id % {every} = 0").select(F.col("chunk_id").alias("query_id"), "repository_id", F.col("embedding").alias("vector"))


def exact(rows, asked, k=10):
    return search.search_blocks(rows.withColumn("repository_id", F.lit("all")), asked.withColumn("repository_id", F.lit("all")), k)


def pairs(df):
    return {(r["query_id"], r["chunk_id"]) for r in df.select("query_id", "chunk_id").collect()}


@pytest.mark.parametrize("n", [2000, 6000])
def test_a_tenth_of_the_vectors_is_read(spark, tmp_path, n):
    """On vectors that have themes, as embeddings do: recall of 0.9 or more from at most a tenth of the rows."""
    rows, path = table(spark, clustered(n, 40)).repartition(4), str(tmp_path / "index")
    vector_index.build(rows, path)
    asked = queries_of(rows, n // 40)
    found = vector_index.search(spark, path, asked)
    want, got = pairs(exact(rows, asked)), pairs(found)
    assert len(want & got) >= 0.9 * len(want)
    assert vector_index.stored(spark, path).select("cell").distinct().count() <= 1.5 * n**0.5
    assert vector_index.calibration(spark, path)["recall"] >= 0.9
    # what the folders hold that a query reads
    near = vector_index.probed(spark, path, asked, vector_index.calibration(spark, path)["probes"])
    read = near.join(vector_index.stored(spark, path), "cell").count() / asked.count()
    assert read <= 0.1 * n


def test_all_cells_are_the_exact_search(spark, tmp_path):
    rows, path = table(spark, clustered(700, 12)), str(tmp_path / "index")
    rows = rows.unionByName(spark.createDataFrame([(5000, "r0", [0.0] * 32)], SCHEMA))
    vector_index.build(rows, path, n_cells=20)
    asked = queries_of(rows)
    plain = [tuple(r) for r in exact(rows, asked).select("query_id", "chunk_id", "rank").orderBy("query_id", "rank").collect()]
    for options in ({}, {"max_query_bytes": 0}, {"max_named_cells": 0}):
        out = vector_index.search(spark, path, asked, probes=1000, **options).select("query_id", "chunk_id", "rank").orderBy("query_id", "rank").collect()
        assert [tuple(r) for r in out] == plain
    scoped = vector_index.search(spark, path, asked, probes=1000, scoped=True)
    assert pairs(scoped) == pairs(search.search_blocks(rows, asked))


def test_the_index_grows_and_shrinks(spark, tmp_path):
    v, path = clustered(900, 12), str(tmp_path / "index")
    base, more = table(spark, v[:600]), table(spark, v[600:], first=600)
    vector_index.build(base, path)
    centres = spark.read.parquet(f"{path}/centres").count()
    for part in (more, more):  # a batch that comes again changes nothing
        vector_index.append(part, path, "b1")
        assert vector_index.stored(spark, path).count() == 900
    asked = queries_of(base.unionByName(more))
    assert pairs(vector_index.search(spark, path, asked, probes=1000)) == pairs(exact(base.unionByName(more), asked))
    vector_index.append(more.filter("chunk_id < 700"), path, "b1")  # a smaller form of the batch replaces it
    left = base.unionByName(more.filter("chunk_id < 700"))
    assert vector_index.stored(spark, path).count() == 700 and spark.read.parquet(f"{path}/centres").count() == centres
    files = lambda: {tuple(r) for r in vector_index.stored(spark, path).select("cell", F.input_file_name()).distinct().collect()}
    before = files()
    cell = vector_index.stored(spark, path).filter("chunk_id = 7").first()["cell"]
    assert vector_index.remove(spark, path, spark.createDataFrame([(7,), (99_999,)], "chunk_id long")) == 1
    assert {c for c, _ in before ^ files()} == {cell}
    assert pairs(vector_index.search(spark, path, asked, probes=1000)) == pairs(exact(left.filter("chunk_id != 7"), asked))
    assert vector_index.remove(spark, path, left.filter("chunk_id < 300").select("chunk_id")) > 0
    assert vector_index.stored(spark, path).count() == 400  # folders left empty are gone
    with pytest.raises(ValueError):
        vector_index.append(more, path, "base")


def test_plans_prune_folders_and_move_no_vectors(spark, tmp_path):
    rows, path = table(spark, clustered(400, 8)), str(tmp_path / "index")
    vector_index.build(rows, path)
    plan = vector_index.search(spark, path, queries_of(rows), probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan and " IN " in plan.split("PartitionFilters")[1][:200]
    assert plan.count("Exchange") == 1  # that of the tops


def test_empty_and_equal_vectors(spark, tmp_path):
    none, path = table(spark, clustered(10, 2)).limit(0), str(tmp_path / "empty")
    vector_index.build(none, path)
    assert vector_index.search(spark, path, queries_of(table(spark, clustered(3, 1)))).count() == 0
    with pytest.raises(ValueError):
        vector_index.append(table(spark, clustered(3, 1)), path, "b")
    same, path = table(spark, np.ones((300, 8))), str(tmp_path / "same")
    vector_index.build(same, path)
    assert [r["chunk_id"] for r in vector_index.search(spark, path, queries_of(same, 300)).orderBy("rank").collect()] == list(range(10))


def test_query_blocks_meet_vector_blocks(spark):
    """A query set beyond the bound: one repository holds most of both sides, one has vectors only, one queries only."""
    rng = np.random.default_rng(2)
    v = [(i, "hot" if i % 4 else f"r{i % 5}", [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(900)]
    rows = spark.createDataFrame([*v, (2000, None, [1.0] * 6), (2001, "lonely", [1.0] * 6), (2002, "hot", [0.0] * 6)], SCHEMA)
    asked = queries_of(rows, 9).unionByName(spark.createDataFrame([(-1, "nowhere", [1.0] * 6)], "query_id long, repository_id string, vector array<float>"))
    want = sorted(tuple(r) for r in search.search_many(rows, asked, 5).select("query_id", "chunk_id", "rank").collect())
    for options in ({}, {"max_query_bytes": 0}, {"max_query_bytes": 500, "block_rows": 70}):
        out = search.search_blocks(rows, asked, 5, **options)
        assert sorted(tuple(r) for r in out.select("query_id", "chunk_id", "rank").collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def met_in_pairs(rows, asked, k):
    """Every pair as a row, scored by the column expression."""
    from quarry.functions import vectors

    met = rows.join(asked.withColumnRenamed("vector", "_q"), "repository_id").select("query_id", "chunk_id", vectors.cosine(F.col("embedding"), F.col("_q")).alias("score"))
    return search.best(met, k)


def test_products_score_to_the_last_bit(spark):
    """Copies of vectors, in all places of a table, tie; vectors and queries of length zero have no score and come last."""
    rng = np.random.default_rng(5)
    some = rng.normal(size=(90, 24)).astype(np.float32)
    v = some[rng.integers(0, 90, 3000)]
    v[rng.integers(0, 3000, 40)] = 0
    rows = table(spark, v).repartition(5)
    asked = queries_of(rows, 30).unionByName(queries_of(table(spark, np.zeros((2, 24)), first=9000), 1))
    few = rows.filter("chunk_id % 500 = 0 OR embedding[0] = 0")
    for held, k in ((rows, 7), (few, 40)):
        want = sorted(tuple(r) for r in met_in_pairs(held, asked, k).select("query_id", "rank", "chunk_id", "score").collect())
        for options in ({}, {"max_query_bytes": 0}, {"max_query_bytes": 9000, "block_rows": 400}):
            got = search.search_blocks(held, asked, k, **options).select("query_id", "rank", "chunk_id", "score")
            assert sorted(tuple(r) for r in got.collect()) == want


def test_a_product_is_bounded_in_memory():
    """20,000 queries meet 4,000 vectors: all their scores at once would be 640 MB."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(1)
    asked, held = rng.normal(size=(20_000, 8)), pd.Series(list(rng.normal(size=(4_000, 8)).astype(np.float32)))
    tracemalloc.start()
    tops = search._Tops(list(range(20_000)), asked, 3)
    tops.add(pd.Series(np.arange(4_000)), held)
    found = pd.concat(tops.found())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 60_000 and peak < 120e6


def test_searches_make_no_pairs_of_rows(spark):
    rows = table(spark, clustered(400, 8))
    centres = search.cells(rows, n_cells=8)
    for out in (search.search_many(rows, queries_of(rows)), search.search_cells(rows, queries_of(rows), centres, probes=4)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "MapInPandas" in plan and out.count() == 80

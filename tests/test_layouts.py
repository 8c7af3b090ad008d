import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.operators import search, tables
from quarry.sources import bucketed, lookup
from quarry.sources import corpus as sources

FILES = "id string, repository_id string, path string, language string, checksum_sha256 string, size_bytes int, created_at int"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges_above(plan, mark):
    """How many exchanges lie between the root and each scan that ``mark`` is found in."""
    stack, out = [], []
    for line in plan.split("\n"):
        depth = len(re.match(r"[\s:|]*(?:\+- )?", line).group())
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, line))
        if mark in line and "Scan" in line:
            out.append(sum("Exchange" in x and "Broadcast" not in x for _, x in stack))
    return out


def file_rows(spark, n, step=1, tag=""):
    return spark.createDataFrame([(f"{tag}{i}", f"r{i % 3}", f"p{i}", "x", f"s{i}{tag}", i, i) for i in range(0, n, step)], FILES)


def test_the_stored_side_is_not_exchanged(spark):
    keys, name = ["repository_id", "path"], "layout_files"
    first = bucketed.save(file_rows(spark, 200), name, keys, buckets=8)
    try:
        merged = tables.upsert_files(spark.table(name), file_rows(spark, 300, 7, "n"))
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            plan = plan_of(merged)
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert exchanges_above(plan, first.lower()) == [0] and plan.count("Exchange") >= 1
        plain = tables.upsert_files(file_rows(spark, 200), file_rows(spark, 300, 7, "n"))
        second = bucketed.merge(spark, name, file_rows(spark, 300, 7, "n"), keys, tables.upsert_files, buckets=8)
        want = sorted(map(tuple, plain.select("id", "path", "checksum_sha256", "created_at").collect()))
        assert sorted(map(tuple, spark.table(name).select("id", "path", "checksum_sha256", "created_at").collect())) == want
        assert (first, second) == ("layout_files_0", "layout_files_1") and bucketed.generations(spark, name) == [0, 1]
        bucketed.merge(spark, name, file_rows(spark, 10, 1, "m"), keys, tables.upsert_files, buckets=8)
        assert bucketed.generations(spark, name) == [1, 2]
    finally:
        for g in bucketed.generations(spark, name):
            spark.sql(f"DROP TABLE {name}_{g}")


def test_rows_that_are_not_unique_stop_the_job(spark):
    old, new = file_rows(spark, 5), file_rows(spark, 3, 1, "n")
    with pytest.raises(Exception, match="not unique on repository_id, path: r1, p1"):
        tables.upsert_files(old, new.unionByName(new.filter("path = 'p1'"))).collect()
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "chunk_id string, embedding array<float>")
    assert tables.put_vectors(vectors, vectors.filter("chunk_id = 'a'")).count() == 2
    with pytest.raises(Exception, match="not unique on chunk_id: a"):
        tables.put_vectors(vectors, vectors.unionByName(vectors.filter("chunk_id = 'a'"))).collect()


def test_texts_stay_where_they_are(spark, tmp_path):
    rows = [(f"c{i}", f"f{i % 50}", i, i + 1, f"text {i} " * 20) for i in range(2000)]
    chunks = spark.createDataFrame(rows, "id string, file_id string, start_line int, end_line int, content string")
    chunks.write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    files = spark.createDataFrame([(f"f{i}", f"p/{i}", None) for i in range(50)], "id string, path string, language string")
    ranked = spark.createDataFrame([("q", f"c{i * 7}", 1.0 - i / 100, i + 1) for i in range(20)] + [("z", "absent", 0.5, 1)], "query_id string, chunk_id string, score double, rank int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if all tables were large
    try:
        assert exchanges_above(plan_of(search._chunks_of(F.broadcast(ranked), chunks)), "file_id") == [0]
        few, many = search.hits(ranked, chunks, files), search.hits(ranked, chunks, files, max_rows=3)
        assert sorted(map(tuple, few.select("rank", "chunk_id", "path", "content").collect())) == sorted(map(tuple, many.select("rank", "chunk_id", "path", "content").collect()))
        assert sorted(r["rank"] for r in few.collect()) == list(range(1, 21))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_trees_are_listed_by_tasks(spark, tmp_path):
    root = tmp_path / "tree"
    for p in ["a/x.jl", "a-b/x.jl", "a/.hidden/y.jl", ".top", "_u/z.jl", "a/deep/er/still/w.jl", "b c/é.jl"]:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(p.encode())
    (root / "empty").mkdir()
    os.symlink(root / "a", root / "linked")
    os.symlink(root / ".top", root / "link.jl")
    want = [Path(d, f).relative_to(root).as_posix() for d, _, names in os.walk(root) for f in names if not Path(d, f).is_symlink()]
    for options in ({}, {"folders_per_task": 1, "batch_rows": 1}):
        listed = sources.list_tree(spark, str(root), **options).collect()
        assert [r["path"] for r in listed] == sorted(want, key=lambda p: p.split("/"))
        assert all(r["size_bytes"] == len(r["path"].encode()) for r in listed)
    read = sources.read_tree(spark, "r", str(root), max_bytes=10).collect()
    assert {r["path"]: bytes(r["content"]) for r in read} == {p: p.encode() if len(p.encode()) <= 10 else b"" for p in want}
    assert sources.list_tree(spark, str(root / "empty")).count() == 0


def scanned_rows(df):
    """The rows that the files gave to the plan, by its metric."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    found = []

    def walk(p):
        if "Scan" in p.nodeName():
            found.append(p.metrics().apply("numOutputRows").value())
        p = p.executedPlan() if p.nodeName() == "AdaptiveSparkPlan" else p
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    return sum(found)


@pytest.mark.parametrize("kind", ["range", "hash"])
def test_lookups_read_few_row_groups(spark, tmp_path, kind):
    key = F.col("id") if kind == "range" else F.md5(F.col("id").cast("string"))
    rows = spark.range(200_000).select(key.cast("string").alias("key"), F.col("id").alias("n"))
    path = str(tmp_path / "t")
    lookup.save(rows, path, "key", files=20, row_group_bytes=1 << 16)
    asked = rows.filter("n % 40000 = 17")
    out = lookup.look_up(spark, path, asked, "key")
    assert sorted(r["n"] for r in out.collect()) == [17 + 40_000 * i for i in range(5)]
    assert scanned_rows(lookup.look_up(spark, path, asked, "key")) < 0.2 * 200_000
    many = rows.filter("n % 1000 = 3")
    assert {r["n"] for r in lookup.look_up(spark, path, many, "key", max_keys=50).collect()} == {3 + 1000 * i for i in range(200)}
    assert lookup.look_up(spark, path, asked.limit(0), "key").count() == 0
    absent = spark.createDataFrame([("zz",), (None,)], "key string")
    assert lookup.look_up(spark, path, absent, "key").count() == 0

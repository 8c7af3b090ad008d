import json

import pytest
from pyspark.sql import functions as F

from quarry import schemas as S
from quarry.operators import discover, embed, evaluate, jobs, registry, search, tables
from quarry.plans import index
from quarry.sources import corpus as sources
from quarry.streaming import jobs as streams

FILES = {
    "lib/solver.jl": b"f(x) = 2x\n", "lib/panel.vue": b"<template/>\n", "notes/start.rst": b"Notes\n=====\n", "COPYING.txt": b"free\n", "Gemfile": b"source :here\n", "lib/.npmrc": b"token=1\n",
    "lib/store.p12": b"0", "web/yarn.lock": b"x\n", "lib/obj/made.c": b"int x;\n", "web/site.min.js": b"x", "web/photo.tiff": b"II\x00", "ledger.qqq": b"1\n", "lib/__init__.py": b"",
}
KEPT = {"lib/solver.jl", "lib/panel.vue", "notes/start.rst", "COPYING.txt", "Gemfile", "lib/__init__.py"}


def corpus(spark, files, repository="r"):
    return spark.createDataFrame([(repository, p, len(c), bytearray(c)) for p, c in files.items()], S.CORPUS)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_gates(spark):
    gated = discover.gated(corpus(spark, FILES))
    assert {r["path"] for r in gated.filter("keep").collect()} == KEPT
    assert rows(discover.skip_report(gated), "reason", "files") == [("excluded_dir", 1), ("generated", 1), ("lockfile", 1), ("secret", 2), ("unsupported_type", 2)]
    binary = discover.gated(corpus(spark, {"a.py": b"x\x00", "b.py": b"x" * 50, "c.py": b""}), max_bytes=20)
    assert {(r["path"], r["reason"]) for r in binary.collect()} == {("a.py", "binary"), ("b.py", "too_large"), ("c.py", None)}


def test_directory_source(spark, tmp_path):
    for p, c in FILES.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(c)
    (tmp_path / "link.jl").symlink_to(tmp_path / "lib/solver.jl")
    got = {r["path"]: bytes(r["content"]) for r in sources.read_tree(spark, "r", str(tmp_path)).collect()}
    assert got == FILES


def test_limits(spark):
    files = corpus(spark, {"a/x.py": b"1" * 10, "a-b/x.py": b"1" * 10, "b.py": b"1" * 10, "c.bin": b"1" * 99})
    sized = discover.sized(discover.classified(files))
    assert rows(discover.repository_limits(sized, max_files=3, max_bytes=30), "files", "bytes", "within") == [(3, 30, True)]
    assert rows(discover.limit_breakers(sized, max_files=2, max_bytes=99), "path", "broken") == [("b.py", "files")]
    assert rows(discover.limit_breakers(sized, max_files=9, max_bytes=15), "path", "broken") == [("a-b/x.py", "bytes")]  # a comes before a-b
    assert index.build(files, embed.HashProvider(8), max_files=2).files.count() == 0


def test_index_and_update_equal_a_rebuild(spark):
    first = {"steps.jl": b"".join(b"step(%d) = %d\n" % (i, 2 * i) for i in range(65)), "notes.rst": b"a\nb\nc\nd\n", "gone.jl": b"x\n", "empty.jl": b""}
    second = {k: v for k, v in first.items() if k != "gone.jl"} | {"notes.rst": b"a\nb\ne\nd\n", "new.jl": b"y\n"}
    p = embed.HashProvider(16)
    old = index.build(corpus(spark, first), p)
    assert rows(old.chunks.join(old.files.select(F.col("id").alias("file_id"), "path"), "file_id"), "path", "start_line", "end_line") == [("gone.jl", 1, 1), ("notes.rst", 1, 4), ("steps.jl", 1, 40), ("steps.jl", 31, 65)]
    scanned = spark.createDataFrame([("r",)], "repository_id string")
    new, again = index.update(old, corpus(spark, second), scanned, p), index.build(corpus(spark, second), p)
    for a, b, columns in ((new.files, again.files, ["id", "path", "language", "checksum_sha256"]), (new.chunks, again.chunks, ["id", "file_id", "content"]), (new.embeddings, again.embeddings, ["chunk_id", "embedding"])):
        assert rows(a, *columns) == rows(b, *columns)
    emptied = index.update(old, corpus(spark, {}), scanned, p)
    assert (emptied.files.count(), emptied.chunks.count(), emptied.embeddings.count()) == (0, 0, 0)


def test_search(spark):
    contents = ["open(door) = 1", "close(door) = 0", "struct Window end"]
    chunks = spark.createDataFrame([(f"c{i}", "r", t) for i, t in enumerate(contents)], "id string, repository_id string, content string")
    vectors = embed.embed(chunks, embed.HashProvider(64))
    query = vectors.filter("chunk_id = 'c0'").first()["embedding"]
    best = search.search_one(vectors, "r", query, 2).collect()
    assert best[0]["chunk_id"] == "c0" and best[0]["score"] == pytest.approx(1, abs=1e-3) and len(best) == 2
    assert search.search_one(vectors, "other", query).count() == 0
    queries = spark.createDataFrame([("q", "r", query), ("z", "other", query)], "query_id string, repository_id string, vector array<float>")
    many, blocks = search.search_many(vectors, queries, 2), search.search_blocks(vectors, queries, 2)
    assert rows(many, "query_id", "chunk_id", "rank") == rows(blocks, "query_id", "chunk_id", "rank")
    assert rows(many, "query_id", "chunk_id", "rank") == rows(search.search_blocks(vectors, queries, 2, max_query_bytes=0), "query_id", "chunk_id", "rank")


def test_ties_go_to_the_smaller_id(spark):
    vectors = spark.createDataFrame([(i, "r", [1.0, 0.0]) for i in (3, 1, 2)], "chunk_id long, repository_id string, embedding array<float>")
    queries = spark.createDataFrame([("q", "r", [1.0, 0.0])], "query_id string, repository_id string, vector array<float>")
    for f in (search.search_many, search.search_blocks):
        assert [r["chunk_id"] for r in f(vectors, queries, 2).orderBy("rank").collect()] == [1, 2]


def test_statuses(spark):
    repos = spark.createDataFrame([("a", "me"), ("b", "me"), ("c", "you")], "id string, owner_id string")
    vectors = spark.createDataFrame([("a",), ("c",)], "repository_id string")
    asked = [("1", "me", "a", "q", None), ("2", "me", "a", "q", 60), ("3", "me", "a", "q", 999), ("4", "me", "a", "", 5), ("5", "me", "b", "q", 5), ("6", "me", "c", "q", 5), ("7", "me", "x", "q", 5), ("8", "me", "a", "q" * 1001, 5)]
    out = search.statuses(spark.createDataFrame(asked, "query_id string, owner_id string, repository_id string, query string, top_k int"), repos, vectors)
    assert [(r["status"], r["k"]) for r in out.orderBy("query_id").collect()] == [("ok", 10), ("ok", 50), ("invalid", None), ("invalid", None), ("not_indexed", None), ("not_found", None), ("not_found", None), ("invalid", None)]


def test_recall_of_the_cell_index(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(600, 16))
    vectors = spark.createDataFrame([(i, "r", [float(y) for y in x]) for i, x in enumerate(v)], "chunk_id long, repository_id string, embedding array<float>")
    queries = vectors.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "repository_id", F.col("embedding").alias("vector"))
    exact = search.search_blocks(vectors, queries).select("query_id", "chunk_id")
    centres = search.cells(vectors, n_cells=16)
    found = search.search_cells(vectors.drop("repository_id"), queries, centres, probes=8).select("query_id", "chunk_id")
    assert exact.join(found, ["query_id", "chunk_id"]).count() >= 0.9 * exact.count()


def test_metrics(spark):
    labelled = spark.createDataFrame([("q1", ["a"]), ("q2", ["b", "b"]), ("q3", ["z"])], "query_id string, relevant_paths array<string>")
    ranked = spark.createDataFrame([("q1", "x", 1), ("q1", "x", 2), ("q1", "a", 3), ("q2", "b", 1), ("q3", "y", 1), ("q3", "z", 11)], "query_id string, path string, rank int")
    out = evaluate.metrics(labelled, ranked).first()
    assert out["n_queries"] == 3 and out["recall_at_1"] == pytest.approx(1 / 3) and out["recall_at_5"] == pytest.approx(2 / 3) and out["mrr"] == pytest.approx((1 / 2 + 1) / 3)
    with pytest.raises(Exception, match="no labelled queries"):
        evaluate.metrics(labelled.limit(0), ranked).collect()


def test_labelled_queries(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"query": "a", "relevant_paths": ["x", "y", "x"]}\n\n' + json.dumps({"query": "b", "relevant_paths": ["z"]}) + "\n")
    assert rows(sources.read_labelled(spark, str(tmp_path / "q.jsonl")), "query", "relevant_paths") == [("a", ["x", "y"]), ("b", ["z"])]


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1), ("r2", 2)], "repository_id string, n int")
    path = sources.write_snapshot(df, str(tmp_path / "t"))
    assert rows(sources.read_snapshot(spark, path, "repository_id string, n int"), "repository_id", "n") == [("r1", 1), ("r2", 2)]


def test_keyed_maintenance(spark):
    old = spark.createDataFrame([("1", "r", "a", "x", "s1", 7), ("2", "r", "b", "x", "s2", 8), ("3", "o", "a", "x", "s3", 9)], "id string, repository_id string, path string, language string, checksum_sha256 string, created_at int").withColumn("size_bytes", F.lit(1))
    new = spark.createDataFrame([("9", "r", "a", None, "s1", 70), ("8", "r", "c", "y", "s4", 71)], "id string, repository_id string, path string, language string, checksum_sha256 string, created_at int").withColumn("size_bytes", F.lit(2))
    up = tables.upsert_files(old, new)
    assert {tuple(r) for r in up.select("id", "path", "language", "created_at").collect()} == {("1", "a", None, 7), ("2", "b", "x", 8), ("3", "a", "x", 9), ("8", "c", "y", 71)}
    scanned = spark.createDataFrame([("r",)], "repository_id string")
    assert rows(tables.prune_files(up, scanned, new), "id") == [("1",), ("3",), ("8",)]
    assert rows(tables.prune_files(up, scanned, new.limit(0)), "id") == [("3",)]
    with pytest.raises(ValueError):
        tables.unique_or_fail(old.unionByName(old), ["repository_id", "path"])
    assert rows(tables.file_changes(old.filter("repository_id = 'r'"), new), "path", "change") == [("a", "unchanged"), ("b", "removed"), ("c", "added")]


def test_registration(spark):
    asked = spark.createDataFrame([(1, "me", "https://github.com/o/r"), (2, "me", "https://github.com/o/r.git"), (3, "you", "https://github.com/o/r"), (4, "me", "nope"), (5, "me", "https://github.com/o/old"), (6, "me", None)], "request_id int, owner_id string, url string")
    there = spark.createDataFrame([("me", "github", "o", "old")], "owner_id string, provider string, owner_name string, repo_name string")
    assert rows(registry.registered(asked, there), "request_id", "result") == [(1, "created"), (2, "conflict"), (3, "created"), (4, "invalid"), (5, "conflict"), (6, "invalid")]
    users = spark.createDataFrame([("1", "ada.lind@uni.example"), ("2", "per@sea.example")], "id string, email string")
    assert rows(registry.same_email(users, spark.createDataFrame([(" Ada.LIND@Uni.Example\n",)], "email string")), "id") == [("1",)]


def test_jobs(spark):
    made = spark.createDataFrame([("1", "a", "running", 1, 3, None), ("2", "b", "running", 3, 3, "e"), ("3", "c", "running", 1, 3, None), ("4", "d", "queued", 0, 3, None)], "id string, repository_id string, status string, attempts int, max_attempts int, error string")
    old = F.when(F.col("id") != "3", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    j = made.withColumns({"heartbeat_at": old, "locked_by": F.lit("w"), "locked_at": old, "current_file": F.lit("f"), "finished_at": F.lit(None).cast("timestamp"), "commit_sha": F.lit(None).cast("string"), "created_at": F.lit("2024-01-01").cast("timestamp")})
    now = F.lit("2024-01-01 00:05:00").cast("timestamp")
    out = {r["id"]: r for r in jobs.expire(j, now).collect()}
    assert [(out[i]["status"], out[i]["expired"], out[i]["error"], out[i]["locked_by"], out[i]["finished_at"] is not None) for i in "1234"] == [("queued", True, None, None, False), ("failed", True, "worker lease expired", None, True), ("running", False, None, "w", False), ("queued", False, None, "w", False)]
    failed = {r["id"]: r for r in jobs.fail_or_requeue(j, spark.createDataFrame([("2", "quota exceeded; " * 300)], "id string, error string"), now).collect()}
    assert failed["2"]["status"] == "failed" and len(failed["2"]["error"]) == 2000 and failed["1"]["status"] == "running"
    done = {r["id"]: r for r in jobs.mark_succeeded(j, spark.createDataFrame([("1", "sha")], "id string, commit_sha string"), now).collect()}
    assert (done["1"]["status"], done["1"]["commit_sha"], done["1"]["current_file"]) == ("succeeded", "sha", None)
    assert rows(jobs.enqueue(j, spark.createDataFrame([("d", "9"), ("e", "8"), ("e", "7")], "repository_id string, new_id string")), "repository_id", "job_id", "created") == [("d", "4", False), ("e", "7", True)]


def test_model_provider(spark):
    chunks = spark.createDataFrame([(str(i), "r", "x" * i) for i in range(5)], "id string, repository_id string, content string")

    def load():
        return lambda texts: [[float(len(t)), 0.0, 1.0] for t in texts]

    made = embed.embed(chunks, embed.provider("model", 3, load=load, batch_size=2))
    assert {r["chunk_id"]: r["embedding"][0] for r in made.collect()}["3"] == pytest.approx(3 / 10**0.5)
    assert embed.embed(chunks.limit(0), embed.provider("model", 3, load=load)).count() == 0
    with pytest.raises(Exception, match="width 4"):
        embed.embed(chunks, embed.provider("model", 4, load=load)).collect()
    with pytest.raises(ValueError):
        embed.provider("unknown")


def test_index_stream_equals_the_batch(spark, tmp_path):
    p, state = embed.HashProvider(8), {}
    corpus(spark, {"a.py": b"x\n", "b.py": b"y\n"}).write.parquet(str(tmp_path / "in"))

    def load():
        return state.get("index") or index.build(corpus(spark, {}), p)

    def store(made):
        state["index"] = index.Index(*[spark.createDataFrame(x.collect(), x.schema) for x in (made.files, made.chunks, made.embeddings)])

    for _ in range(2):  # the second run finds nothing new
        streams.index_stream(spark, str(tmp_path / "in"), str(tmp_path / "check"), load, store, p).awaitTermination()
    batch = index.build(corpus(spark, {"a.py": b"x\n", "b.py": b"y\n"}), p)
    assert rows(state["index"].chunks, "id", "content") == rows(batch.chunks, "id", "content")


def test_partial_scans_do_not_prune(spark, tmp_path):
    """A repository that comes in two batches keeps the files of the first; a marked batch prunes."""
    p, state = embed.HashProvider(8), {"index": index.build(corpus(spark, {}), embed.HashProvider(8))}

    def store(made):
        state["index"] = index.Index(*[spark.createDataFrame(x.collect(), x.schema) for x in (made.files, made.chunks, made.embeddings)])

    def run(files, marked):
        batch = corpus(spark, files)
        if marked:
            batch = batch.unionByName(spark.createDataFrame([("r", None, None, None)], S.CORPUS))
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.index_stream(spark, str(tmp_path / "in"), str(tmp_path / "check"), lambda: state["index"], store, p).awaitTermination()
        return [x for (x,) in rows(state["index"].files, "path")]

    assert run({"a.jl": b"1\n", "b.jl": b"2\n"}, False) == ["a.jl", "b.jl"]
    assert run({"c.jl": b"3\n"}, False) == ["a.jl", "b.jl", "c.jl"]
    assert run({"b.jl": b"4\n"}, True) == ["b.jl"]
    assert state["index"].chunks.count() == state["index"].embeddings.count() == 1


def test_payloads_have_the_keys_of_their_type(spark):
    for kind, keys in S.EVENT_KEYS.items():
        made = spark.range(1).select(jobs.payload(kind, **{k: F.lit("x") for k in reversed(keys)})).first()[0]
        assert list(json.loads(made)) == list(keys)
        with pytest.raises(ValueError):
            jobs.payload(kind, **{k: F.lit("x") for k in keys}, other=F.lit("x"))
        with pytest.raises(ValueError):
            jobs.payload(kind)


def test_silent_workers_as_a_stream(spark, tmp_path):
    beats = [("j1", "2024-01-01 00:00:00", "running"), ("j1", "2024-01-01 00:00:30", "running"), ("j2", "2024-01-01 00:00:00", "running"), ("j2", "2024-01-01 00:00:20", "succeeded"), ("z", "2024-01-02 00:00:00", "running")]
    df = spark.createDataFrame(beats, "job_id string, ts string, state string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = streams.silent_workers(df)
    assert rows(batch, "job_id", "heartbeats") == [("j1", 2), ("z", 1)]
    stream = streams.silent_workers(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("silent"), "job_id", "heartbeats") == [("j1", 2)]  # z's session is still open


def test_own_folder_only_where_none_is_named():
    from types import SimpleNamespace

    from quarry.sources.shared import shared_folder

    def session(folder, master="local[2]", app="app"):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(master=master, applicationId=app))

    assert shared_folder(session("/shared/x/")) == "/shared/x"
    own = shared_folder(session(None))
    assert own == shared_folder(session(None)) != shared_folder(session(None, app="other"))
    with pytest.raises(ValueError):
        shared_folder(session(None, master="spark://host:7077"))

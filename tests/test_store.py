import random

import pytest
from pyspark.sql import functions as F

from quarry import schemas as S
from quarry.operators import embed
from quarry.plans import index
from quarry.sources.store import Store
from quarry.streaming import scans

P = embed.HashProvider(8)


def packed(spark, files, repository="r"):
    return spark.createDataFrame([(repository, p, len(c), bytearray(c)) for p, c in files.items()], S.CORPUS)


def tables(made):
    return {n: sorted(map(tuple, getattr(made, n).select(*c).collect())) for n, c in (("files", ["repository_id", "path", "checksum_sha256"]), ("chunks", ["id", "file_id", "content"]), ("embeddings", ["chunk_id", "embedding"]))}


def merged(store, rows, repositories=("r",), **options):
    scanned = rows.sparkSession.createDataFrame([(r,) for r in repositories], "repository_id string")
    return index.update_store(store, rows, scanned, P, **options)


def folders(store):
    return {(name, b): v for name, held in store.current.items() for b, v in held.items()}


def test_a_changed_file_rewrites_one_bucket(spark, tmp_path):
    store = Store(spark, str(tmp_path), index.STORED, buckets=8)
    files = {f"d/f{i}.jl": f"x = {i}\n".encode() * 50 for i in range(30)}
    merged(store, packed(spark, files))
    first, number = folders(store), store.number
    assert tables(index.stored_index(store)) == tables(index.build(packed(spark, files), P))
    files["d/f7.jl"] = b"changed = true\n"
    written = merged(store, packed(spark, files))
    assert all(len(b) == 1 for b in written.values()) and set(written) == {"files", "chunks", "embeddings"}
    changed = {k for k in folders(store) if first.get(k) != folders(store)[k] and k[0] != "contents"}
    assert changed == {(n, b[0]) for n, b in written.items()}
    assert tables(index.stored_index(store)) == tables(index.build(packed(spark, files), P))
    assert merged(store, packed(spark, files)) == {}  # the same again writes nothing
    del files["d/f9.jl"]
    assert {len(b) for b in merged(store, packed(spark, files)).values()} == {1}
    assert tables(index.stored_index(store)) == tables(index.build(packed(spark, files), P))
    # another reader sees the last state, and one that named an earlier commit still sees that
    assert tables(index.stored_index(Store(spark, str(tmp_path), index.STORED, buckets=8))) == tables(index.stored_index(store))
    old = Store(spark, str(tmp_path), index.STORED, buckets=8).refresh(number)
    assert {r["path"] for r in old.read("files").collect()} == {f"d/f{i}.jl" for i in range(30)}
    merged(store, packed(spark, {}))
    assert [store.read(n).count() for n in ("files", "chunks", "embeddings")] == [0, 0, 0]
    store.forget(keep=1)
    assert spark.read.parquet(f"{tmp_path}/pointer").select("number").distinct().count() == 1
    assert Store(spark, str(tmp_path), index.STORED, buckets=8).number == store.number


def test_commits_that_fail_or_repeat_change_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"t": "k string, n int"}, buckets=4)
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, n int").withColumn("bucket", store.bucket("k"))
    store.commit({}, {"t": rows}, stream="s", epoch=3)
    bad = rows.withColumn("n", F.when(F.col("k") == "b", F.raise_error("no")).otherwise(F.col("n")).cast("int"))
    with pytest.raises(Exception, match="no"):
        store.commit({"t": (bad, [0, 1, 2, 3])})
    with pytest.raises(ValueError):
        store.commit({"t": (rows, [])})
    again = Store(spark, str(tmp_path), {"t": "k string, n int"}, buckets=4)
    assert sorted(tuple(r)[:2] for r in again.read("t").collect()) == [("a", 1), ("b", 2), ("c", 3)]
    assert again.done("s", 3) and again.done("s", 2) and not again.done("s", 4) and not again.done("other", 0)
    b = rows.filter("k = 'a'").first()["bucket"]
    again.commit({"t": (rows.limit(0), [b])})
    assert "a" not in {r["k"] for r in again.read("t").collect()} and again.read("t", [b]).count() == 0


def counting(spark, seen):
    """A model that says how many texts it was given."""

    def load():
        def model(texts):
            seen.add(len(texts))
            return [[float(len(t)), 1.0, float(t.count("x"))] for t in texts]

        return model

    return embed.provider("model", 3, model_name="counting", load=load)


def test_equal_texts_are_embedded_once(spark, tmp_path):
    store, seen = Store(spark, str(tmp_path), index.STORED, buckets=4), spark.sparkContext.accumulator(0)
    using = counting(spark, seen)
    files = {f"f{i}.jl": f"x{i % 5}\n".encode() for i in range(40)}
    scanned = spark.createDataFrame([("r",)], "repository_id string")
    index.update_store(store, packed(spark, files), scanned, using)
    assert seen.value == 5 and store.read("embeddings").count() == 40 and store.read("contents").count() == 5
    files |= {"new.jl": b"x3\n", "other.jl": b"unlike\n"}
    index.update_store(store, packed(spark, files), scanned, using)
    assert seen.value == 6 and store.read("contents").count() == 6
    rebuilt = index.build(packed(spark, files), using)
    assert tables(index.stored_index(store)) == tables(rebuilt)
    other = embed.embed_new(store.read("chunks"), embed.HashProvider(8), store.read("contents"))  # another model's vectors are not taken
    assert other[1].count() == 6


def test_tasks_get_equal_lengths(spark):
    rng = random.Random(1)
    texts = [(str(i), "hot" if i % 10 else f"r{i}", "y" * int(rng.paretovariate(0.9) * 20 % 5000 + 1)) for i in range(4000)] + [("n", "r", None), ("e", "r", "")]
    df = spark.createDataFrame(texts, "id string, repository_id string, content string")
    out = embed.balanced(df, "content", "id", 6).withColumn("task", F.spark_partition_id())
    sums = [r["n"] for r in out.groupBy("task").agg(F.sum(F.length("content")).alias("n")).collect()]
    assert len(sums) == 6 and max(sums) < 2 * sum(sums) / 6 and out.count() == 4002 and out.drop("task").columns == df.columns
    spread = out.groupBy("task").agg(F.min(F.length("content")).alias("lo"), F.max(F.length("content")).alias("hi")).orderBy("lo").collect()
    assert all(a["hi"] <= 1.1 * b["lo"] + 1 for a, b in zip(spread, spread[1:]))
    assert embed.balanced(df.limit(0), "content", "id").count() == 0


def scan_rows(spark, repository, scan, files, announced=None):
    rows = [(repository, scan, p, len(c), bytearray(c), None) for p, c in files.items()]
    return spark.createDataFrame(rows + ([(repository, scan, None, None, None, announced)] if announced is not None else []), scans.SCANS)


def test_scans_that_span_batches(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "store")
    store = Store(spark, root, index.STORED, buckets=4)

    def arrive(*parts, **options):
        for p in parts:
            p.coalesce(1).write.mode("append").parquet(source)
        scans.scan_stream(spark, source, str(tmp_path / "check"), store, P, **options).awaitTermination()
        return sorted((r["repository_id"], r["path"]) for r in store.read("files").collect())

    one = {f"f{i}.jl": f"a{i}\n".encode() for i in range(6)}
    part = lambda lo, hi: {p: one[p] for p in list(one)[lo:hi]}
    limits = {"max_files": 6, "max_bytes": 100}
    assert arrive(scan_rows(spark, "r", "s1", part(0, 2)), **limits) == []
    assert arrive(scan_rows(spark, "r", "s1", part(2, 4)), scan_rows(spark, "q", "s1", {"x.jl": b"1\n"}, 1), **limits) == [("q", "x.jl")]
    whole = arrive(scan_rows(spark, "r", "s1", part(4, 6), 6), **limits)
    assert whole == [("q", "x.jl"), *[("r", p) for p in one]]
    assert tables(index.stored_index(store)) == tables(index.build(packed(spark, one).unionByName(packed(spark, {"x.jl": b"1\n"}, "q")), P))
    assert arrive(**limits) == whole  # nothing new
    # the mark may come first; a file that is not in the new scan goes; binary and skipped files are announced as well
    assert arrive(scan_rows(spark, "r", "s2", {}, 3), **limits) == whole
    assert arrive(scan_rows(spark, "r", "s2", {"f0.jl": b"new\n", "b.jl": b"\x00", "z.lock.hcl": b"-"}), **limits) == [("q", "x.jl"), ("r", "f0.jl")]
    # limits count the whole scan: seven files in two batches are one too many, and nothing changes
    more = {f"m{i}.jl": b"m\n" for i in range(7)}
    arrive(scan_rows(spark, "q", "s3", dict(list(more.items())[:4])), **limits)
    assert arrive(scan_rows(spark, "q", "s3", dict(list(more.items())[4:]), 7), **limits) == [("q", "x.jl"), ("r", "f0.jl")]
    number = store.number
    # an epoch that is repeated finds itself committed
    done = spark.createDataFrame([("r", "s1", 6, 6, 24, True)], scans.COMPLETE)
    scans.merge_scans(store, spark.read.schema(scans.SCANS).parquet(source), done, P, stream="scans", epoch=store.epochs["scans"])
    assert store.number == number
    with pytest.raises(ValueError, match="twice"):
        twice = scan_rows(spark, "r", "s4", {"a.jl": b"1"}).unionByName(scan_rows(spark, "r", "s4", {"a.jl": b"2"}))
        scans.merge_scans(store, twice, spark.createDataFrame([("r", "s4", 2, 2, 2, True)], scans.COMPLETE), P, stream="scans", epoch=99)

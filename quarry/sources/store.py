"""Tables in buckets: a change writes the buckets it touches anew, and one small file says which folders are current.

A row's bucket is a hash of the key that it is merged by. Each commit writes folders of its own
(``name/version=.../bucket=...``) and nothing over others; its last step is one file below ``pointer`` that lists, for
every table and bucket, the folders that count from now on. A reader that has that list sees one state of all tables,
whatever is written meanwhile, and a commit that fails before that file leaves nothing that anyone reads. A commit may
carry the name and epoch of a stream; when the stream repeats an epoch after a failure, ``done`` says so.

One writer at a time. ``forget`` drops the lists before the last ones; the folders that no list names any more can then
be deleted by age.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "kind string, name string, bucket int, version string, epoch long, number long"


class Store:
    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], buckets: int = 64):
        self.spark, self.root, self.schemas, self.buckets = spark, root.rstrip("/"), schemas, buckets
        self.number, self.current, self.epochs = -1, {name: {} for name in schemas}, {}
        self.refresh()

    def refresh(self, number: int | None = None) -> Store:
        """Take up the last commit, or that of a given number."""
        try:
            lists = self.spark.read.schema(POINTER).parquet(f"{self.root}/pointer")
        except Exception as e:  # there has been no commit
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self
        last = lists.agg(F.max("number")).first()[0] if number is None else number
        self.number, self.current, self.epochs = last, {name: {} for name in self.schemas}, {}
        for r in lists.filter(F.col("number") == last).collect():  # tables x buckets, and a row per stream
            if r["kind"] == "stream":
                self.epochs[r["name"]] = r["epoch"]
            else:
                self.current[r["name"]].setdefault(r["bucket"], []).append(r["version"])
        return self

    def bucket(self, *key: Column | str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int").alias("bucket")

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The table with its ``bucket``; only the folders of the given buckets are opened."""
        held = self.current[name]
        paths = [f"{self.root}/{name}/version={v}/bucket={b}" for b in sorted(held) if buckets is None or b in set(buckets) for v in held[b]]
        if not paths:
            return self.spark.createDataFrame([], f"{self.schemas[name]}, bucket int")
        rows = self.spark.read.schema(f"{self.schemas[name]}, version string, bucket int").option("basePath", f"{self.root}/{name}")
        return rows.parquet(*paths).drop("version")

    def done(self, stream: str, epoch: int) -> bool:
        return self.epochs.get(stream, -1) >= epoch

    def commit(self, replaced: dict[str, tuple[DataFrame, list[int]]], added: dict[str, DataFrame] | None = None, *, stream: str | None = None, epoch: int = 0) -> int:
        """Write and switch to the new state. ``replaced`` has, by table, the rows of the given buckets, which may be none;
        ``added`` has rows to be stored beside what is there. All rows carry their ``bucket``. Returns the commit's number."""
        number = self.number + 1
        current = {name: dict(held) for name, held in self.current.items()}
        for name, (rows, touched) in replaced.items():
            version = self._written(name, rows, number)
            for b in touched:
                current[name].pop(b, None)
            for b in version[1]:
                if b not in touched:
                    raise ValueError(f"rows of bucket {b} of {name}, which is not to be replaced")
                current[name][b] = [version[0]]
        for name, rows in (added or {}).items():
            version = self._written(name, rows, number)
            for b in version[1]:
                current[name][b] = [*current[name].get(b, []), version[0]]
        epochs = self.epochs | ({stream: epoch} if stream else {})
        rows = [("bucket", name, b, v, None, number) for name, held in current.items() for b, versions in held.items() for v in versions]
        rows += [("stream", s, None, None, e, number) for s, e in epochs.items()]
        rows = rows or [("stream", "", None, None, -1, number)]
        self.spark.createDataFrame(rows, POINTER).coalesce(1).write.mode("append").partitionBy("number").parquet(f"{self.root}/pointer")
        self.number, self.current, self.epochs = number, current, epochs
        return number

    def _written(self, name: str, rows: DataFrame, number: int) -> tuple[str, list[int]]:
        version = f"{number}-{uuid.uuid4().hex}"
        path = f"{self.root}/{name}/version={version}"
        columns = [f.strip().split(" ")[0] for f in self.schemas[name].split(", ")]
        rows.select(*columns, "bucket").repartition("bucket").write.partitionBy("bucket").parquet(path)
        made = self.spark.read.schema(f"{self.schemas[name]}, bucket int").parquet(path)
        return version, [r["bucket"] for r in made.select("bucket").distinct().collect()]

    def forget(self, keep: int = 10) -> None:
        """Drop the lists of all but the last ``keep`` commits."""
        lists = self.spark.read.schema(POINTER).parquet(f"{self.root}/pointer").select("number").distinct().collect()
        for r in lists:
            if r["number"] <= self.number - keep:
                folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/pointer/number={r['number']}")
                folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

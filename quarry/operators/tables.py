"""Keyed maintenance of the file, chunk and vector tables. Every function takes tables and returns the new one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_or_fail(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys' rows; a key that comes twice stops the job."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not twice.isEmpty():
        raise ValueError(f"rows are not unique on {', '.join(keys)}")
    return df


def one_each(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The keys and a struct ``name`` of the other columns. A key that comes twice stops the job that runs the plan; the
    count is combined before the exchange that a join on the keys needs anyway."""
    others = F.struct(*[c for c in df.columns if c not in keys])
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(others).alias(name))
    twice = F.raise_error(F.concat(F.lit(f"rows are not unique on {', '.join(keys)}: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
    return rows.select(*keys, F.when(F.col("_n") == 1, F.col(name)).otherwise(twice).alias(name))


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert new (repository_id, path) rows; on a match take language, size and checksum, and keep id and created_at.
    The new rows must be unique on the key, or the job stops."""
    keys, fresh = ["repository_id", "path"], ["language", "size_bytes", "checksum_sha256"]
    o = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("o"))
    n = one_each(new.select(*old.columns), keys, "n")

    def picked(c: str):
        if c in keys:
            return F.col(c)
        chosen = F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in fresh else F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        return chosen.alias(c)

    return o.join(n, keys, "full_outer").select(*[picked(c) for c in old.columns])


def prune_files(files: DataFrame, scanned: DataFrame, keep: DataFrame) -> DataFrame:
    """Of the ``scanned`` repositories only the files in ``keep`` (repository_id, path) stay; a scanned repository that
    keeps nothing loses all. Others are untouched."""
    repos = scanned.select("repository_id").distinct()
    untouched = files.join(repos, "repository_id", "left_anti")
    kept = files.join(repos, "repository_id", "left_semi").join(keep.select("repository_id", "path").distinct(), ["repository_id", "path"], "left_semi")
    return untouched.unionByName(kept)


def replace_chunks(chunks: DataFrame, changed_files: DataFrame, new: DataFrame) -> DataFrame:
    """The chunks of ``changed_files`` (file_id) give way to ``new``, which may have none for a file."""
    return chunks.join(changed_files.select("file_id").distinct(), "file_id", "left_anti").select(*chunks.columns).unionByName(new.select(*chunks.columns))


def prune_chunks(chunks: DataFrame, scanned: DataFrame, files: DataFrame) -> DataFrame:
    """In scanned repositories, chunks whose file is gone go."""
    repos = scanned.select("repository_id").distinct()
    alive = files.select(F.col("id").alias("file_id"))
    kept = chunks.join(repos, "repository_id", "left_semi").join(alive, "file_id", "left_semi")
    return chunks.join(repos, "repository_id", "left_anti").unionByName(kept.select(*chunks.columns))


def put_vectors(embeddings: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors for the chunk ids of ``new`` replace any that are there; an id that comes twice in it stops the job."""
    fresh = one_each(new.select(*embeddings.columns), ["chunk_id"], "n").select("chunk_id", "n.*")
    return embeddings.join(new.select("chunk_id"), "chunk_id", "left_anti").select(*embeddings.columns).unionByName(fresh.select(*embeddings.columns))


def cascade(tables: dict[str, DataFrame], *, users: DataFrame | None = None, repositories: DataFrame | None = None, files: DataFrame | None = None) -> dict[str, DataFrame]:
    """Delete the given ids (column ``id``) and all that belongs to them: user, repository, file, chunk, vector; a
    repository's jobs and events too."""

    def without(df: DataFrame, gone: DataFrame, column: str) -> DataFrame:
        return df.join(gone.select(F.col("id").alias(column)).distinct(), column, "left_anti").select(*df.columns)

    def of(df: DataFrame, gone: DataFrame, column: str) -> DataFrame:
        return df.join(gone.select(F.col("id").alias(column)).distinct(), column, "left_semi").select("id")

    def both(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
        return a.select("id").unionByName(b.select("id")) if a is not None and b is not None else a if a is not None else b

    out = dict(tables)
    if users is not None:
        if "users" in out:
            out["users"] = without(out["users"], users, "id")
        repositories = both(repositories, of(tables["repositories"], users, "owner_id"))
    if repositories is not None:
        if "repositories" in out:
            out["repositories"] = without(out["repositories"], repositories, "id")
        for name in ("index_jobs", "repository_events"):
            if name in out:
                out[name] = without(out[name], repositories, "repository_id")
        files = both(files, of(tables["repository_files"], repositories, "repository_id"))
    if files is not None:
        out["repository_files"] = without(out["repository_files"], files, "id")
        chunks = of(tables["chunks"], files, "file_id")
        out["chunks"] = without(out["chunks"], chunks, "id")
        out["chunk_embeddings"] = without(out["chunk_embeddings"], chunks, "chunk_id")
    return out


def changed_repositories(heads: DataFrame, repositories: DataFrame) -> DataFrame:
    """Heads (repository_id, head_sha) that differ from what was last indexed; a repository never indexed is changed."""
    last = repositories.select(F.col("id").alias("repository_id"), "last_indexed_sha")
    return heads.join(last, "repository_id").filter(~F.col("head_sha").eqNullSafe(F.col("last_indexed_sha")))


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repository_id, path, change): added, changed, unchanged or removed, by checksum."""
    keys = ["repository_id", "path"]
    o, n = old.select(*keys, F.col("checksum_sha256").alias("o")), new.select(*keys, F.col("checksum_sha256").alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") == F.col("n"), "unchanged").otherwise("changed")
    return o.join(n, keys, "full_outer").select(*keys, change.alias("change"))


def counts(files: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Per repository: files, chunks, vectors, and whether it can be searched."""
    parts = [t.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n")).select("repository_id", *[(F.col("n") if i == j else F.lit(0).cast("long")).alias(c) for j, c in enumerate(("files", "chunks", "vectors"))]) for i, t in enumerate((files, chunks, embeddings))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("repository_id").agg(*[F.sum(c).alias(c) for c in ("files", "chunks", "vectors")]).withColumn("searchable", F.col("vectors") > 0)


def outcome(heads: DataFrame, repositories: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per head: files and chunks indexed, and whether it was skipped as unchanged (then both are 0)."""
    changed = changed_repositories(heads, repositories).select("repository_id", F.lit(True).alias("changed"))
    sums = counts(files, chunks, chunks.limit(0).select("repository_id")).select("repository_id", "files", "chunks")
    out = heads.select("repository_id").join(changed, "repository_id", "left").join(sums, "repository_id", "left")
    done = lambda c: F.when(F.col("changed"), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).alias(f"{c}_indexed")
    return out.select("repository_id", done("files"), done("chunks"), F.col("changed").isNull().alias("skipped"))


def listed(df: DataFrame, by: list[str], newest_first: bool = False, within: list[str] | None = None) -> DataFrame:
    """Rows in listing order; equal rows are told apart by id."""
    order = [F.desc(c) if newest_first else F.asc(c) for c in by]
    return df.orderBy(*[F.asc(c) for c in within or []], *order, *([F.asc("id")] if "id" in df.columns else []))


def looked_up(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``table`` whose key is asked for, once each."""
    return table.join(keys.select(*on), on, "left_semi").select(*table.columns)


def public_repository(repositories: DataFrame) -> DataFrame:
    return repositories.select("id", "provider", "owner_name", "repo_name", "clone_url", "default_branch", "last_indexed_sha", "status", "created_at")


def public_job(jobs: DataFrame) -> DataFrame:
    return jobs.select("id", "repository_id", "status", "commit_sha", "attempts", "max_attempts", "files_total", "files_done", "current_file", "error", "created_at", "started_at", "finished_at")

"""Indexing a corpus: discover, inventory, chunk, embed and merge into the tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import schemas as S
from quarry.operators import chunk, discover, embed, tables
from quarry.sources.shared import cut
from quarry.sources.store import Store

#: Tables of a stored index; chunks and vectors share their file's bucket, contents have one of their own.
STORED = {
    "files": "id string, repository_id string, path string, language string, size_bytes long, checksum_sha256 string",
    "chunks": "id string, repository_id string, file_id string, chunk_index int, start_line int, end_line int, content string, content_sha256 string",
    "embeddings": "chunk_id string, repository_id string, model string, dim int, embedding array<float>, file_id string",
    "contents": embed.CONTENTS,
}


@dataclass
class Index:
    files: DataFrame
    chunks: DataFrame
    embeddings: DataFrame


def build(corpus: DataFrame, provider: embed.Provider, *, window: int = S.WINDOW_LINES, overlap: int = S.OVERLAP_LINES, max_file_bytes: int = S.MAX_FILE_BYTES, max_files: int = S.MAX_REPOSITORY_FILES, max_bytes: int = S.MAX_REPOSITORY_BYTES) -> Index:
    """Files, chunks and vectors of a corpus. A repository over a limit contributes nothing."""
    sized = discover.sized(discover.classified(corpus), max_file_bytes)
    # the limits need paths and sizes only; contents are read for what is left
    over = discover.repository_limits(sized.select("repository_id", "path", "size_bytes", "keep"), max_files=max_files, max_bytes=max_bytes).filter("NOT within")
    kept = discover.sniffed(sized.filter("keep").join(over.select("repository_id"), "repository_id", "left_anti")).filter("keep")
    files = discover.inventory(kept)
    chunks = chunk.file_chunks(files, kept, window=window, overlap=overlap)
    return Index(files, chunks, embed.embed(chunks, provider))


def update(old: Index, corpus: DataFrame, scanned: DataFrame, provider: embed.Provider, *, complete: DataFrame | None = None, **options) -> Index:
    """The tables after a new scan of the ``scanned`` repositories. Only added and changed files are chunked and
    embedded; the result equals a full rebuild. Where only a part of a scan is there, ``complete`` (repository_id) names
    the repositories whose scan is whole: the others keep the files that are not in ``corpus``."""
    limits = {k: v for k, v in options.items() if k.startswith("max_")}
    windows = {k: v for k, v in options.items() if k in ("window", "overlap")}
    sized = discover.sized(discover.classified(corpus), limits.get("max_file_bytes", S.MAX_FILE_BYTES))
    over = discover.repository_limits(sized.select("repository_id", "path", "size_bytes", "keep"), **{k: v for k, v in limits.items() if k != "max_file_bytes"}).filter("NOT within")
    within = scanned.select("repository_id").join(over.select("repository_id"), "repository_id", "left_anti")
    kept = discover.sniffed(sized.filter("keep").join(within, "repository_id", "left_semi")).filter("keep")
    new = cut(discover.inventory(kept), "scanned-files")  # narrow, and read several times below
    mine = old.files.join(within, "repository_id", "left_semi")
    changes = tables.file_changes(mine, new)
    fresh = changes.filter(F.col("change").isin("added", "changed")).select("repository_id", "path")
    files = tables.upsert_files(old.files, new.withColumn("created_at", F.lit(None).cast("timestamp")).select(*old.files.columns) if "created_at" in old.files.columns else new.select(*old.files.columns))
    files = tables.prune_files(files, within if complete is None else within.join(complete.select("repository_id"), "repository_id", "left_semi"), new)
    changed = files.join(fresh, ["repository_id", "path"], "left_semi")
    chunks = cut(chunk.file_chunks(changed, kept, **windows), "new-chunks")
    kept_chunks = tables.prune_chunks(old.chunks, within, files)
    all_chunks = tables.replace_chunks(kept_chunks.select(*chunks.columns), changed.select(F.col("id").alias("file_id")), chunks)
    vectors = embed.embed(chunks, provider)
    alive = old.embeddings.join(all_chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    return Index(files, all_chunks, tables.put_vectors(alive.select(*vectors.columns), vectors))


def update_store(store: Store, corpus: DataFrame, scanned: DataFrame, provider: embed.Provider, *, complete: DataFrame | None = None, stream: str | None = None, epoch: int = 0, **options) -> dict[str, list[int]]:
    """``update`` on stored tables, of which only the buckets of files that are new, changed or gone are read and written
    anew; files, chunks and vectors change in one step. Texts whose vector is stored already are not embedded again. An
    epoch that has been committed before changes nothing. Returns the buckets written, by table."""
    if stream and store.done(stream, epoch):
        return {}
    windows = {k: v for k, v in options.items() if k in ("window", "overlap")}
    limits = {k: v for k, v in options.items() if k in ("max_files", "max_bytes")}
    sized = discover.sized(discover.classified(corpus), options.get("max_file_bytes", S.MAX_FILE_BYTES))
    over = discover.repository_limits(sized.select("repository_id", "path", "size_bytes", "keep"), **limits).filter("NOT within")
    within = cut(scanned.select("repository_id").distinct().join(over.select("repository_id"), "repository_id", "left_anti"), "scanned")
    kept = discover.sniffed(sized.filter("keep").join(within, "repository_id", "left_semi")).filter("keep")
    new = cut(discover.inventory(kept).withColumn("bucket", store.bucket("id")), "scanned-files")
    mine = store.read("files").join(within, "repository_id", "left_semi")  # narrow rows
    changes = tables.file_changes(mine, new)
    if complete is not None:
        whole = complete.select("repository_id").distinct().withColumn("whole", F.lit(True))
        changes = changes.join(whole, "repository_id", "left").filter("whole OR change != 'removed'")
    file_id = discover.file_id(F.col("repository_id"), F.col("path"))
    changes = cut(changes.filter("change != 'unchanged'").select("repository_id", "path", "change", file_id.alias("file_id")).withColumn("bucket", store.bucket("file_id")), "file-changes")
    touched = sorted(r["bucket"] for r in changes.select("bucket").distinct().collect())
    if not touched:
        if stream:
            store.commit({}, stream=stream, epoch=epoch)
        return {}
    fresh = new.join(changes.filter("change != 'removed'").select("repository_id", "path"), ["repository_id", "path"], "left_semi")
    gone = changes.select("file_id")

    def merged(name: str, key: str, rows: DataFrame) -> tuple[DataFrame, list[int]]:
        old = store.read(name, touched)
        left = old.join(gone.withColumnRenamed("file_id", key), key, "left_anti")
        return left.select(*old.columns).unionByName(rows.select(*old.columns)), touched

    chunks = chunk.file_chunks(fresh, kept, **windows).withColumn("bucket", store.bucket("file_id"))
    chunks = cut(chunks, "new-chunks")
    vectors, contents = embed.embed_new(chunks, provider, store.read("contents"))
    replaced = {"files": merged("files", "id", fresh), "chunks": merged("chunks", "file_id", chunks), "embeddings": merged("embeddings", "file_id", vectors)}
    store.commit(replaced, {"contents": contents.withColumn("bucket", store.bucket("key"))}, stream=stream, epoch=epoch)
    return {name: touched for name in replaced}


def stored_index(store: Store) -> Index:
    return Index(*[store.read(name).select(*[f.name for f in S.struct(ddl).fields]) for name, ddl in STORED.items() if name != "contents"])

"""Schemas of the tables and the parameters' defaults."""

from __future__ import annotations

from pyspark.sql import types as T

CORPUS = "repository_id string, path string, size_bytes long, content binary"
USERS = "id string, email string, is_active boolean, created_at timestamp, updated_at timestamp"
REPOSITORIES = "id string, owner_id string, provider string, owner_name string, repo_name string, clone_url string, default_branch string, last_indexed_sha string, status string, created_at timestamp, updated_at timestamp"
FILES = "id string, repository_id string, path string, language string, size_bytes long, checksum_sha256 string, created_at timestamp"
CHUNKS = "id string, repository_id string, file_id string, chunk_index int, start_line int, end_line int, content string, content_sha256 string, token_count int, created_at timestamp"
EMBEDDINGS = "chunk_id string, repository_id string, model string, dim int, embedding array<float>"
JOBS = "id string, repository_id string, status string, commit_sha string, attempts int, max_attempts int, files_total int, files_done int, current_file string, error string, locked_by string, locked_at timestamp, heartbeat_at timestamp, created_at timestamp, started_at timestamp, finished_at timestamp"
EVENTS = "id string, repository_id string, event_type string, payload string, created_at timestamp"
LABELED_QUERIES = "query string, relevant_paths array<string>"

#: Statuses and event types.
REPOSITORY_STATUSES = ("failed", "indexed", "indexing", "pending")
JOB_STATUSES = ("failed", "queued", "running", "succeeded")
ACTIVE_STATUSES = ("queued", "running")
EVENT_TYPES = ("index_completed", "index_failed", "index_queued", "index_skipped_unchanged", "index_started", "repository_created")
#: The keys of an event type's payload.
EVENT_KEYS = {
    "repository_created": ("slug",),
    "index_queued": ("job_id",),
    "index_started": ("job_id",),
    "index_skipped_unchanged": ("job_id", "commit_sha"),
    "index_completed": ("job_id", "commit_sha", "files", "chunks"),
    "index_failed": ("job_id", "status", "error"),
}

#: Defaults that are part of the results.
MAX_REPOSITORY_BYTES, MAX_REPOSITORY_FILES, MAX_FILE_BYTES = 200 * 1024 * 1024, 5000, 1024 * 1024
WINDOW_LINES, OVERLAP_LINES = 40, 10
EMBEDDING_DIM, EMBEDDING_BATCH = 768, 32
TOP_K_DEFAULT, TOP_K_CAP, TOP_K_MAX, QUERY_CHARS_MAX = 10, 50, 200, 1000
LEASE_SECONDS, MAX_ATTEMPTS = 60, 3
SNIFF_BYTES = 8192
EVAL_K = (1, 5, 10)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)

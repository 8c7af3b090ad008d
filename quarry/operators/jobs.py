"""Job and event tables as batch transformations. ``now`` is a parameter, so that runs repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import schemas as S

ERROR_CHARS, EVENT_ERROR_CHARS = 2000, 500
LEASE_EXPIRED = "worker lease expired"


def set_columns(df: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    """New values where ``when`` holds; types stay."""
    types = dict(df.dtypes)
    hit = F.coalesce(when, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)).cast(types[c]) for c, v in values.items() if c in types})


def null() -> Column:
    return F.lit(None)


def expired(now: Column, lease_seconds: int = S.LEASE_SECONDS) -> Column:
    """A running job whose heartbeat is older than the lease; one without a heartbeat is not expired."""
    return (F.col("status") == "running") & (F.col("heartbeat_at") < now - F.make_interval(secs=F.lit(lease_seconds)))


def expire(jobs: DataFrame, now: Column, lease_seconds: int = S.LEASE_SECONDS) -> DataFrame:
    """Expired jobs fail if no attempts are left, else queue again; ``expired`` marks them."""
    spent = F.col("attempts") >= F.col("max_attempts")
    marked = jobs.withColumn("expired", F.coalesce(expired(now, lease_seconds), F.lit(False)))
    values = {
        "error": F.when(spent, F.lit(LEASE_EXPIRED)).otherwise(F.col("error")),
        "finished_at": F.when(spent, now),
        "locked_by": null(),
        "locked_at": null(),
        "current_file": null(),
        "status": F.when(spent, "failed").otherwise("queued"),
    }
    return set_columns(marked, F.col("expired"), values)


def fail_or_requeue(jobs: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """``failures`` (id, error): the job fails if no attempts are left, else queues again."""
    joined = jobs.join(failures.select("id", F.col("error").alias("_error"), F.lit(True).alias("_failed")), "id", "left")
    spent = F.col("attempts") >= F.col("max_attempts")
    values = {"status": F.when(spent, "failed").otherwise("queued"), "error": F.substring("_error", 1, ERROR_CHARS), "finished_at": F.when(spent, now), "current_file": null(), "locked_by": null(), "locked_at": null()}
    return set_columns(joined, F.col("_failed"), values).select(*jobs.columns)


def mark_succeeded(jobs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """``outcomes`` (id, commit_sha)."""
    joined = jobs.join(outcomes.select("id", F.col("commit_sha").alias("_sha"), F.lit(True).alias("_done")), "id", "left")
    values = {"status": F.lit("succeeded"), "commit_sha": F.col("_sha"), "finished_at": now, "current_file": null(), "locked_by": null(), "locked_at": null()}
    return set_columns(joined, F.col("_done"), values).select(*jobs.columns)


def active(jobs: DataFrame) -> DataFrame:
    """The oldest queued or running job of each repository."""
    order = Window.partitionBy("repository_id").orderBy("created_at", "id")
    rows = jobs.filter(F.col("status").isin(*S.ACTIVE_STATUSES)).withColumn("_nth", F.row_number().over(order))
    return rows.filter("_nth = 1").drop("_nth")


def enqueue(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (repository_id, new_id): the job that answers each, and whether it is new. A repository with an
    active job gets that one; several requests for one repository share a job."""
    there = active(jobs).select("repository_id", F.col("id").alias("_there"))
    first = requests.groupBy("repository_id").agg(F.min("new_id").alias("_new"))
    joined = first.join(there, "repository_id", "left")
    return joined.select("repository_id", F.coalesce("_there", "_new").alias("job_id"), F.col("_there").isNull().alias("created"))


def latest_event(events: DataFrame, by: str = "repository_id", at: str = "created_at") -> DataFrame:
    """The newest event of each repository; of equally new ones the one with the largest id."""
    others = [c for c in events.columns if c not in (by, at, "id")]
    return events.groupBy(by).agg(F.max(F.struct(at, "id", *others)).alias("_e")).select(by, "_e.*")


def payload(event_type: str, **columns: Column) -> Column:
    """The JSON payload of an event, with the keys of its type; its error text is cut."""
    if event_type not in S.EVENT_TYPES:
        raise ValueError(f"unknown event type: {event_type}")
    keys = S.EVENT_KEYS[event_type]
    if set(columns) != set(keys):
        raise ValueError(f"the payload of {event_type} has the keys {', '.join(keys)}")
    fields = [(F.substring(columns[k], 1, EVENT_ERROR_CHARS) if k == "error" else columns[k]).alias(k) for k in keys]
    return F.to_json(F.struct(*fields))


def record(events: DataFrame, new: DataFrame) -> DataFrame:
    """Append; events are never changed."""
    return events.unionByName(new.select(*events.columns))

"""The ingestion queue as tables: counters from items, terminal states, order, claim, retry, freshness."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("queued", "running", "completed", "partial", "failed", "cancelled")
ITEM_STATUSES = ("pending", "running", "completed", "failed", "skipped", "cancelled")


def latest_items(items: DataFrame) -> DataFrame:
    """An item may be recorded more than once: its last record, ties by status."""
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("recorded_at"), F.desc_nulls_last("status"), F.desc_nulls_last("chunks"))
    return items.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def counters(items: DataFrame) -> DataFrame:
    """Per job: items by state, and the first one that runs."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ITEM_STATUSES]
    running = F.min_by("id", F.when(F.col("status") == "running", F.struct("position", "id"))).alias("current_item")
    return items.groupBy("job_id").agg(F.count("*").alias("total"), *counts, running)


def terminal_status(counts: DataFrame) -> DataFrame:
    """State that follows from the items: cancelled before failed and partial, before completed."""
    open_ = F.col("pending") + F.col("running")
    good = F.col("completed") + F.col("skipped")
    state = (
        F.when(open_ > 0, "running").when(F.col("cancelled") > 0, "cancelled")
        .when((F.col("failed") > 0) & (good > 0), "partial").when(F.col("failed") > 0, "failed").otherwise("completed")
    )
    return counts.withColumn("derived_status", state)


def queue_status(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def rank_of_status() -> Column:
    return F.when(F.col("status") == "running", 0).when(F.col("status") == "queued", 1).otherwise(2)


def listing(jobs: DataFrame) -> DataFrame:
    """All jobs in list order: running, queued (oldest first), then the rest (newest first). Sorted by range, not in one task."""
    active = rank_of_status() < 2
    return jobs.orderBy(rank_of_status(), F.when(active, F.col("created_at")).asc_nulls_last(), F.when(~active, F.col("created_at")).desc_nulls_last(), "id")


def page(jobs: DataFrame, limit: int, offset: int = 0, status: str | None = None, kind: str | None = None) -> DataFrame:
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1..200 and offset not negative")
    for name, value in (("status", status), ("kind", kind)):
        jobs = jobs.where(F.col(name) == value) if value else jobs
    return listing(jobs).offset(offset).limit(limit)


def claim_next(jobs: DataFrame) -> DataFrame:
    """The oldest queued job, unless one runs."""
    running = jobs.where("status = 'running'").select(F.lit(1).alias("busy")).limit(1)
    oldest = jobs.where("status = 'queued'").orderBy("created_at", "id").limit(1)
    return oldest.join(running, F.lit(True), "left_anti")


def next_per_kind(jobs: DataFrame) -> DataFrame:
    """The oldest queued job of every kind."""
    return jobs.where("status = 'queued'").groupBy("kind").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))


def retry_items(items: DataFrame) -> DataFrame:
    """What a retry of each job would take: failed and cancelled items, numbered anew."""
    w = Window.partitionBy("job_id").orderBy("position", "id")
    rows = items.where(F.col("status").isin("failed", "cancelled"))
    return rows.select("job_id", "id", "position", (F.row_number().over(w) - 1).alias("new_position"))


def nested(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """Jobs with their items in order. A job's items are bounded by the upload limits."""
    one = items.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", "status"))).alias("items"))
    return jobs.join(one, jobs.id == one.job_id, "left").select(jobs.id, jobs.status, F.coalesce(F.transform("items", lambda x: x["id"]), F.array().cast("array<string>")).alias("item_ids"))


def online(beats: DataFrame, key: str, at: str, now: Column, offline_after: int = 15) -> DataFrame:
    last = beats.groupBy(key).agg(F.max(at).alias("last_seen"))
    return last.withColumn("online", F.unix_timestamp("last_seen") >= F.unix_timestamp(now) - offline_after)


def delete_jobs(jobs: DataFrame, items: DataFrame, which: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, items) that stay when the jobs that `which` holds for go, and their items with them."""
    kept = jobs.where(~F.coalesce(F.expr(which), F.lit(False)))
    return kept, items.join(kept.select(F.col("id").alias("job_id")), "job_id", "left_semi")


def zipped(items: DataFrame, manifest: DataFrame, order: str) -> DataFrame:
    """(job_id, n, relative_path, other_path): the n-th item of a job beside the n-th row of its manifest."""
    a = items.select("job_id", "relative_path", F.row_number().over(Window.partitionBy("job_id").orderBy("position", "id")).alias("n"))
    b = manifest.select("job_id", F.col("relative_path").alias("other_path"), F.row_number().over(Window.partitionBy("job_id").orderBy(order)).alias("n"))
    return a.join(b, ["job_id", "n"])

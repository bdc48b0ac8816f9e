"""Operational views: jobs, stages, statuses, durations, requests, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions import scalars


def latest_job(jobs: DataFrame, key: str = "repository_id") -> DataFrame:
    """The newest job of each key; of equals the smallest job_id. A maximum with partial sums, so a key with many jobs is no hot spot."""
    best = F.max_by(F.struct(*jobs.columns), F.struct("created_at", -F.col("job_id")))
    return jobs.groupBy(key).agg(best.alias("_j")).select("_j.*")


def page(df: DataFrame, keys: list, number: int = 1, size: int = 20) -> DataFrame:
    """A page of df in the order of keys, which must end with a unique one; at most 100 rows. The total is df.count()."""
    if not 1 <= size <= 100 or number < 1:
        raise ValueError("pages count from 1 and hold 1 to 100 rows")
    return df.orderBy(*keys).offset((number - 1) * size).limit(size)


def status_fallback(repositories: DataFrame, jobs: DataFrame) -> DataFrame:
    """repositories (repository_id, status) with progress and phase of the latest job, or what the status stands for."""
    out = repositories.join(jobs.select("repository_id", F.col("progress").alias("_g"), F.col("phase").alias("_p")), "repository_id", "left")
    ready = F.col("status") == "ready"
    return out.withColumns({"progress": F.coalesce("_g", F.when(ready, 100).otherwise(0)), "phase": F.coalesce("_p", F.when(ready, "indexing").otherwise("ingestion"))}).drop("_g", "_p")


def stages(jobs: DataFrame) -> DataFrame:
    """Each job's state of each of the five stages."""
    each = jobs.withColumn("stage", F.explode(F.array(*(F.lit(p) for p in rules.PHASES))))
    return each.withColumn("state", scalars.stage_state(F.col("stage"), F.col("phase"), F.col("status")))


def repositories_by_status(repositories: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """status and n, with 0 for statuses that none has."""
    statuses = statuses or rules.STATUSES
    rows = repositories.filter(F.col("status").isin(*statuses)).groupBy("status").agg(F.count("*").alias("n"))
    every = repositories.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return every.join(rows, "status", "left").fillna(0, ["n"])


def phase_durations(events: DataFrame, bounds: tuple[float, ...] = (1, 60, 3600, 86_400)) -> DataFrame:
    """phase, n, seconds and cumulative counts le_<bound>: how long each phase lasts until the key's next event."""
    after = F.lead("ts").over(Window.partitionBy("key").orderBy("ts", "event_id"))
    rows = events.withColumn("_s", F.unix_micros(after) / 1e6 - F.unix_micros("ts") / 1e6).filter("_s is not null")
    return rows.groupBy("phase").agg(F.count("*").alias("n"), F.sum("_s").alias("seconds"), *(F.count_if(F.col("_s") <= b).alias(f"le_{b:g}") for b in bounds))


def request_stats(log: DataFrame) -> DataFrame:
    """Requests, mean and median duration by method, path and status."""
    return log.groupBy("method", "path", "status").agg(F.count("*").alias("n"), F.avg("duration").alias("mean"), F.percentile("duration", 0.5).alias("median"))


def index_progress(chunks: DataFrame, batch: int = 500) -> DataFrame:
    """repository_id, done and progress after each batch of chunks: min(99, 80 + 20 * done / total)."""
    n = chunks.groupBy("repository_id").agg(F.count("*").alias("total"))
    each = n.withColumn("_b", F.explode(F.sequence(F.lit(1), F.ceil(F.col("total") / batch).cast("int")))).withColumn("done", F.least(F.col("_b") * batch, F.col("total")))
    return each.select("repository_id", "total", "done", F.least(F.lit(99), 80 + F.floor(20 * F.col("done") / F.col("total"))).cast("long").alias("progress"))


def recent_distinct(queries: DataFrame, most: int = 6) -> DataFrame:
    """Each user's last distinct queries, the newest first."""
    q = queries.withColumn("query", F.trim("query")).filter("query <> ''").groupBy("user_id", "query").agg(F.max("ts").alias("ts"))
    return q.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "query"))).filter(F.col("rank") <= most)


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is missing."""
    return rows.join(parents.select(key).distinct(), key, "left_anti")


def rate_violations(calls: DataFrame, limit: int, window: str) -> DataFrame:
    """client_key, window start and number of calls, where they exceed the limit in a fixed window."""
    n = calls.groupBy("client_key", F.window("ts", window).alias("_w")).agg(F.count("*").alias("calls"))
    return n.filter(F.col("calls") > limit).select("client_key", F.col("_w.start").alias("window_start"), "calls", (F.col("calls") - limit).alias("rejected"))


def repository_summary(files: DataFrame, frameworks: DataFrame, cycles: DataFrame) -> DataFrame:
    """One row for each repository: languages, primary language, frameworks, file count and cycles."""
    from . import inventory

    langs = inventory.language_stats(files).groupBy("repository_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "lines")))).alias("detected_languages"))
    base = files.groupBy("repository_id").agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("size_bytes"))
    out = base.join(langs, "repository_id", "left").join(inventory.primary_language(files), "repository_id", "left").join(frameworks, "repository_id", "left").join(cycles, "repository_id", "left")
    return out.fillna(False, ["has_cycles"])

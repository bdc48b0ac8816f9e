"""Queries of jobs, metrics and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions import scalars
from corpuslens.operators import graph, inventory, metrics
from corpuslens.sources import files as sources
from corpuslens.sources.durable import shared_path
from corpuslens.streaming import streams

from .inputs import EVENTS_SQL, LANGUAGE_SQL, events, files, jobs, table
from .registry import query


@query("SELECT repository_id, job_id, created_at, state FROM (SELECT o_custkey AS repository_id, o_orderkey AS job_id, o_orderdate AS created_at, o_orderstatus AS state, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def e1_latest_job(spark, sf_dir):
    return metrics.latest_job(jobs(spark, sf_dir))


@query("SELECT doc_id, source, n_chars, count(*) OVER () AS total FROM documents WHERE lang = 'en' ORDER BY source, doc_id LIMIT 50 OFFSET 50")
def d9_e2_page(spark, sf_dir):
    """The second page of English documents, with the total."""
    d = table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", "source", "n_chars")
    return metrics.page(d, ["source", "doc_id"], 2, 50).join(F.broadcast(d.agg(F.count("*").alias("total"))), how="cross")  # one row


STAGE_SQL = f"""CASE WHEN status = 'ready' THEN 'done' WHEN s < p THEN 'done' WHEN s = p AND status = 'error' THEN 'error' WHEN s = p THEN 'active' ELSE 'pending' END"""


@query(
    f"""SELECT event_id AS job_id, stage, {STAGE_SQL} AS state FROM (
  SELECT event_id, stage, list_position({rules.PHASES!r}, stage) AS s, CAST(event_id % 6 AS INT) AS p, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'ready' ELSE 'running' END AS status FROM events, (SELECT unnest({rules.PHASES!r}) AS stage))"""
)
def b22_stages(spark, sf_dir):
    phase = F.element_at(F.array(F.lit("none"), *(F.lit(p) for p in rules.PHASES)), (F.col("event_id") % 6 + 1).cast("int"))
    j = events(spark, sf_dir).select(F.col("event_id").alias("job_id"), phase.alias("phase"), "status")
    return metrics.stages(j).select("job_id", "stage", "state")


@query(
    """SELECT c_custkey AS repository_id, CASE WHEN j.o_custkey IS NOT NULL THEN CAST(k % 100 AS INT) WHEN c_custkey % 2 = 0 THEN 100 ELSE 0 END AS progress,
  CASE WHEN j.o_custkey IS NOT NULL THEN 'graph' WHEN c_custkey % 2 = 0 THEN 'indexing' ELSE 'ingestion' END AS phase
FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) j ON j.o_custkey = c_custkey"""
)
def b23_status_fallback(spark, sf_dir):
    repos = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repository_id"), F.when(F.col("c_custkey") % 2 == 0, "ready").otherwise("pending").alias("status"))
    j = metrics.latest_job(jobs(spark, sf_dir).filter("state = 'F'")).select("repository_id", (F.col("job_id") % 100).cast("int").alias("progress"), F.lit("graph").alias("phase"))
    return metrics.status_fallback(repos, j).select("repository_id", "progress", "phase")


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'key:' || sha256(CAST(user_id AS VARCHAR)) WHEN user_id % 3 = 1 THEN 'ip:10.0.0.' || user_id ELSE 'ip:unknown' END AS client_key FROM events")
def b24_client_key(spark, sf_dir):
    u, k = F.col("user_id").cast("string"), F.col("user_id") % 3
    return table(spark, sf_dir, "events").select("event_id", scalars.client_key(F.when(k == 0, u), F.when(k == 1, F.concat(F.lit("10.0.0."), u))).alias("client_key"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY 1")
def b25_read_events(spark, sf_dir):
    """Frames of which every seventh is cut off."""
    frames = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 == 0, F.lit('{"k": ')).otherwise(F.col("props")).alias("value"))
    return sources.read_events(frames, "k long").groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, event_type AS status, CAST(event_id AS BIGINT) AS n FROM events")
def a11_event_json(spark, sf_dir):
    """Progress frames as a message sink takes them, read back."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("repo_id"), F.col("event_type").alias("status"), F.col("event_id").alias("n"))
    out = sources.event_json(e, "repo_id", "status", "n")
    return out.select("key", F.from_json("value", "status string, n long").alias("v")).select("key", "v.status", "v.n")


@query("SELECT conv_id, text FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)")
def c15_orphans(spark, sf_dir):
    return metrics.orphans(table(spark, sf_dir, "conversations").select("conv_id", "text"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "conv_id"), "conv_id")


@query("SELECT s AS status, (SELECT count(*) FROM orders WHERE o_orderstatus = s) AS n FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS s)")
def d11_repositories_by_status(spark, sf_dir):
    return metrics.repositories_by_status(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")), ["F", "O", "P", "X"])


@query(
    f"""WITH {EVENTS_SQL}, s AS (SELECT phase, epoch_us(lead(ts) OVER (PARTITION BY key ORDER BY ts, event_id)) / 1e6 - epoch_us(ts) / 1e6 AS s FROM ev)
SELECT phase, count(*) AS n, round(sum(s), 2) AS seconds, count(*) FILTER (s <= 1) AS le_1, count(*) FILTER (s <= 60) AS le_60, count(*) FILTER (s <= 3600) AS le_3600, count(*) FILTER (s <= 86400) AS le_86400 FROM s WHERE s IS NOT NULL GROUP BY 1"""
)
def d12_phase_durations(spark, sf_dir):
    return metrics.phase_durations(events(spark, sf_dir)).withColumn("seconds", F.round("seconds", 2))


@query("SELECT role, CAST(sum(coalesce(length(text), 0) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY role")
def d13_llm_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(scalars.estimate_tokens(F.col("text"))).alias("tokens"))


@query("WITH n AS (SELECT source AS repository_id, count(*) AS total FROM documents GROUP BY 1), b AS (SELECT *, unnest(range(1, CAST(ceil(total / 20.0) AS BIGINT) + 1)) AS b FROM n) SELECT repository_id, total, least(b * 20, total) AS done, CAST(least(99, 80 + 20 * least(b * 20, total) // total) AS BIGINT) AS progress FROM b")
def d16_index_progress(spark, sf_dir):
    return metrics.index_progress(table(spark, sf_dir, "documents").select(F.col("source").alias("repository_id")), batch=20)


@query("SELECT 'GET' AS method, event_type AS path, CASE WHEN event_id % 10 = 0 THEN 500 ELSE 200 END AS status, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY ALL")
def d17_request_stats(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.lit("GET").alias("method"), F.col("event_type").alias("path"), F.when(F.col("event_id") % 10 == 0, 500).otherwise(200).alias("status"), F.col("value").alias("duration"))
    return metrics.request_stats(log).withColumns({"mean": F.round("mean", 6), "median": F.round("median", 6)})


@query("WITH q AS (SELECT user_id, trim(event_type) AS query, max(ts) AS ts FROM events GROUP BY 1, 2) SELECT user_id, query, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, query) AS rank FROM q) WHERE rank <= 3")
def e10_recent_distinct(spark, sf_dir):
    q = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("query"), "ts")
    return metrics.recent_distinct(q, 3).drop("ts")


@query(
    f"""WITH f AS (SELECT source AS repository_id, text, {LANGUAGE_SQL} AS language, string_split(lang || '/' || doc_id || (['.py', '.ts', '/index.js', '/__init__.py'])[CAST(doc_id % 4 AS INT) + 1], '/') AS p FROM documents),
s AS (SELECT repository_id, language, sum(length(text) - length(replace(text, chr(10), ''))) AS lines, min(p) AS p FROM f GROUP BY 1, 2),
b AS (SELECT repository_id, language FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY lines DESC, p, language) AS k FROM s) WHERE k = 1)
SELECT f.repository_id, count(*) AS file_count, CAST(sum(strlen(text)) AS BIGINT) AS size_bytes, any_value(b.language) AS primary_language, CAST((SELECT count(*) FROM s WHERE s.repository_id = f.repository_id) AS INT) AS n_languages,
  CASE WHEN f.repository_id LIKE '%1' THEN 'React' END AS framework, f.repository_id LIKE '%2' AS has_cycles FROM f JOIN b ON b.repository_id = f.repository_id GROUP BY f.repository_id"""
)
def c16_repository_summary(spark, sf_dir):
    f = inventory.file_facts(inventory.detect_language(files(spark, sf_dir)))
    repos = f.select("repository_id").distinct()
    fw = repos.filter("repository_id like '%1'").withColumn("frameworks", F.array(F.lit("React")))
    edges = repos.filter("repository_id like '%2'").select("repository_id", F.lit("a").alias("src"), F.lit("a").alias("dst"))
    cycles = graph.has_cycles(edges.withColumn("node", F.col("src")), edges)
    out = metrics.repository_summary(f, fw, cycles)
    return out.select("repository_id", "file_count", "size_bytes", "primary_language", F.size("detected_languages").alias("n_languages"), F.get("frameworks", F.lit(0)).alias("framework"), "has_cycles")


@query(
    f"""WITH {EVENTS_SQL} SELECT key, s.status, s.progress, s.phase, s.ts FROM (SELECT key, coalesce(min({{'ts': ts, 'event_id': event_id, 'status': status, 'progress': progress, 'phase': phase}}) FILTER (status IN ('ready', 'error')),
  max({{'ts': ts, 'event_id': event_id, 'status': status, 'progress': progress, 'phase': phase}})) AS s FROM ev GROUP BY key)"""
)
def l1_progress_batch(spark, sf_dir):
    return streams.progress_batch(events(spark, sf_dir))


@query(
    f"""WITH {EVENTS_SQL}, g AS (SELECT key, ts, max(CASE WHEN status IN ('ready', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ended, epoch_us(lead(ts) OVER (PARTITION BY key ORDER BY ts, event_id)) / 1e6 - epoch_us(ts) / 1e6 AS silent FROM ev)
SELECT key, ts, round(silent, 3) AS silent FROM g WHERE ended = 0 AND silent > 15"""
)
def l2_stalled_batch(spark, sf_dir):
    return streams.stalled_batch(events(spark, sf_dir)).withColumn("silent", F.round("silent", 3))


CALLS = "SELECT CAST(user_id AS VARCHAR) AS client_key, date_trunc('day', ts) AS window_start, count(*) AS calls, count(*) - 5 AS rejected FROM events GROUP BY ALL HAVING count(*) > 5"


@query(CALLS)
def l3_rate_violations_batch(spark, sf_dir):
    """More than five calls a client and day."""
    c = events(spark, sf_dir).select(F.col("key").alias("client_key"), "ts")
    return metrics.rate_violations(c, 5, "1 day").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT 'r' || doc_id AS repository_id, s.i AS step, CASE WHEN s.i = 5 AND doc_id % 2 = 0 THEN 'parsing' ELSE s.p END AS phase, CASE WHEN s.i = 5 AND doc_id % 2 = 0 THEN 50 ELSE s.g END AS progress, CASE WHEN s.i < 5 THEN 'running' WHEN doc_id % 2 = 0 THEN 'error' ELSE 'ready' END AS status FROM documents, (SELECT unnest([{'i': 0, 'p': 'ingestion', 'g': 10}, {'i': 1, 'p': 'extraction', 'g': 25}, {'i': 2, 'p': 'parsing', 'g': 50}, {'i': 3, 'p': 'graph', 'g': 70}, {'i': 4, 'p': 'indexing', 'g': 90}, {'i': 5, 'p': 'indexing', 'g': 100}]) AS s) WHERE doc_id % 2 = 1 OR s.i < 3 OR s.i = 5")
def l5_pipeline_events(spark, sf_dir):
    """Analyses of which every second fails while parsing."""
    runs = table(spark, sf_dir, "documents").select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("repository_id"), F.when(F.col("doc_id") % 2 == 0, "parsing").alias("failed_phase"))
    return streams.pipeline_events(runs)


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as the table may be one file
    return e.select(F.col("user_id").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")


def _run(stream, mode="append"):
    """Runs a stream over what is there into a table in the shared folder, and reads that."""
    out, at = shared_path(stream.sparkSession, "stream"), shared_path(stream.sparkSession, "stream-state")
    writer = stream.writeStream.option("checkpointLocation", at).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("append").parquet(out))
    writer.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _progress(spark, sf_dir):
    e = _stream(spark, sf_dir)
    kind = F.col("event_type")
    status = F.when(kind == "error", "error").when(kind == "purchase", "ready").otherwise("running")
    return e.select("key", "event_id", "ts", status.alias("status"), (F.col("event_id") % 100).cast("int").alias("progress"), kind.alias("phase"))


@query(
    f"""WITH {EVENTS_SQL} SELECT key, s.status, s.progress, s.phase FROM (SELECT key, coalesce(min({{'ts': ts, 'event_id': event_id, 'status': status, 'progress': progress, 'phase': phase}}) FILTER (status IN ('ready', 'error')),
  max({{'ts': ts, 'event_id': event_id, 'status': status, 'progress': progress, 'phase': phase}})) AS s FROM ev GROUP BY key)"""
)
def l1_progress_stream(spark, sf_dir):
    """The stateful stream's last row of each key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    out = _run(streams.progress_stream(_progress(spark, sf_dir)), "update")
    return out.groupBy("key").agg(F.max_by(F.struct("status", "progress", "phase"), "ts").alias("s")).select("key", "s.*")


@query()
def l2_stalled_stream(spark, sf_dir):
    """Keep-alive rows of keys that are silent for 15 s of event time when the stream's watermark passes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return _run(streams.progress_stream(_progress(spark, sf_dir), stall_ms=15_000), "update")


@query("SELECT count(*) AS events, count(DISTINCT event_id) AS ids FROM events")
def l6_once_each_stream(spark, sf_dir):
    """The event stream joined with itself: each event comes twice and leaves once."""
    e = _stream(spark, sf_dir)
    twice = e.withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_k")
    return _run(streams.once_each(twice)).agg(F.count("*").alias("events"), F.countDistinct("event_id").alias("ids"))


@query(f"SELECT * FROM ({CALLS}) WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def l3_rate_violations_stream(spark, sf_dir):
    """The stream's twin of l3_rate_violations_batch, over the windows that the watermark has closed."""
    c = _stream(spark, sf_dir).select(F.col("key").alias("client_key"), "ts")
    return _run(streams.rate_violations_stream(c, 5, "1 day")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))



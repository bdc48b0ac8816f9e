"""Structured Streaming jobs: progress by key, silent keys, rate limits, ingestion. Each has a batch twin to compare with."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

TERMINAL = ("ready", "error")
PROGRESS = "key string, status string, progress int, phase string, ts timestamp, stalled boolean"


class Progress(StatefulProcessor):
    """The latest state of a key until it ends; with stall_ms, a row for a key that is silent for so long in event time."""

    def __init__(self, stall_ms: int | None = None):
        self.stall_ms = stall_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, progress int, phase string, ts timestamp, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        before = self.last.get() if self.last.exists() else None
        if before and before[4]:
            for _ in rows:  # an ended key stays as it ended
                pass
            return
        end, latest = None, None
        for frame in rows:  # a frame at a time: a key may have any number of events
            frame = frame.sort_values(["ts", "event_id"])
            ends = frame[frame["status"].isin(TERMINAL)]
            at = lambda e: (e["ts"], e["event_id"])
            if len(ends) and (end is None or at(ends.iloc[0]) < at(end)):
                end = ends.iloc[0]
            if len(frame) and (latest is None or at(frame.iloc[-1]) > at(latest)):
                latest = frame.iloc[-1]
        e = latest if end is None else end
        if e is None or (end is None and before and e["ts"] < pd.Timestamp(before[3])):  # an end counts, however late it comes
            return
        self.last.update((e["status"], int(e["progress"]), e["phase"], e["ts"].to_pydatetime(), bool(e["status"] in TERMINAL)))
        if self.stall_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if e["status"] not in TERMINAL:
                self.handle.registerTimer(int(e["ts"].timestamp() * 1000) + self.stall_ms)
        yield pd.DataFrame({"key": [str(key[0])], "status": [e["status"]], "progress": [int(e["progress"])], "phase": [e["phase"]], "ts": [e["ts"]], "stalled": [False]})

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:  # noqa: N802
        s = self.last.get()
        yield pd.DataFrame({"key": [str(key[0])], "status": [s[0]], "progress": [s[1]], "phase": [s[2]], "ts": [pd.Timestamp(s[3])], "stalled": [True]})

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame, stall_ms: int | None = None, lateness: str = "1 day") -> DataFrame:
    """events: key, event_id, ts, status, progress, phase. Needs the RocksDB state store."""
    marked = events.withWatermark("ts", lateness)
    return marked.groupBy("key").transformWithStateInPandas(Progress(stall_ms), PROGRESS, "Update", "EventTime" if stall_ms is not None else "None")


def progress_batch(events: DataFrame) -> DataFrame:
    """The state at the end: the first terminal event, else the latest event, of each key. Minima and maxima, with partial sums."""
    row = F.struct("ts", "event_id", "status", "progress", "phase")
    ends = F.col("status").isin(*TERMINAL)
    out = events.groupBy("key").agg(F.min(F.when(ends, row)).alias("_e"), F.max(row).alias("_l"))
    return out.select("key", F.coalesce("_e", "_l").alias("_s")).select("key", "_s.status", "_s.progress", "_s.phase", "_s.ts")


def stalled_batch(events: DataFrame, seconds: float = 15.0) -> DataFrame:
    """Gaps of over `seconds` between a key's events, before its end: key, ts of the event before the gap, silent seconds."""
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    ended = F.max(F.when(F.col("status").isin(*TERMINAL), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    gap = F.unix_micros(F.lead("ts").over(order)) / 1e6 - F.unix_micros("ts") / 1e6
    return events.withColumns({"_ended": ended, "silent": gap}).filter((F.col("_ended") == 0) & (F.col("silent") > seconds)).select("key", "ts", "silent")


def rate_violations_stream(calls: DataFrame, limit: int, window: str = "1 minute", lateness: str = "1 day") -> DataFrame:
    n = calls.withWatermark("ts", lateness).groupBy("client_key", F.window("ts", window).alias("_w")).agg(F.count("*").alias("calls"))
    return n.filter(F.col("calls") > limit).select("client_key", F.col("_w.start").alias("window_start"), "calls", (F.col("calls") - limit).alias("rejected"))


def once_each(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Events without repeats of an event_id that come within the lateness."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there, into a table of that name in memory, for tests and reports."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


#: progress at the end of each phase of an analysis, as events report it
MILESTONES = {"ingestion": 10, "extraction": 25, "parsing": 50, "graph": 70, "indexing": 90}


def pipeline_events(runs: DataFrame) -> DataFrame:
    """Events of runs (repository_id, failed_phase or null): one for each phase that was reached, then ready or error with the last progress."""
    names = list(MILESTONES)
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p).alias("phase"), F.lit(MILESTONES[p]).alias("progress")) for i, p in enumerate(names)))
    failed = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("failed_phase")), F.lit(0))
    reached = F.when(failed > 0, F.slice(steps, F.lit(1), failed.cast("int"))).otherwise(steps)
    last = F.struct(F.lit(len(names)).alias("i"), F.coalesce("failed_phase", F.lit(names[-1])).alias("phase"), F.when(failed > 0, F.element_at(reached, -1)["progress"]).otherwise(F.lit(100)).alias("progress"))
    rows = runs.select("repository_id", "failed_phase", F.explode(F.concat(reached, F.array(last))).alias("e"))
    status = F.when(F.col("e.i") < len(names), "running").when(F.col("failed_phase").isNull(), "ready").otherwise("error")
    return rows.select("repository_id", F.col("e.i").alias("step"), "e.phase", "e.progress", status.alias("status"))


#: Batch numbers of passes over changed files begin here, above those of any stream.
FIRST_PASS = 10**9


def _ingest(rows: DataFrame, out: str, number: int) -> None:
    """Writes the files, symbols, imports, parse errors and chunks of rows as partitions of this batch. Files come last: until then nothing of the batch is current, and a repeated batch replaces it."""
    from corpuslens.operators import chunking, parse
    from corpuslens.sources import files
    from corpuslens.sources.durable import durable

    rows = durable(rows, "ingested")  # read once: contents are parsed, cut and listed from here
    text = rows.filter("not is_binary").withColumn("content", F.decode(F.encode(F.expr("make_valid_utf8(cast(content as string))"), "utf-8"), "utf-8"))
    parsed = durable(parse.parse_files(text), "parsed")
    symbols = parsed.select("file_id", F.explode("symbols").alias("s")).select("file_id", "s.*")
    imports = parsed.select("file_id", F.explode("imports").alias("s")).select("file_id", "s.*")
    tables = {
        "symbols": symbols, "imports": parse.of_files(imports, text), "errors": parsed.filter("parse_error is not null").select("file_id", "parse_error"), "chunks": chunking.chunk_files(text), "files": rows.drop("content"),
    }
    for name, table in tables.items():
        files.replace_partitions(table, f"{out}/{name}", "batch", F.lit(number))


def _facts(binary: DataFrame, folder: str) -> DataFrame:
    from corpuslens.operators import inventory
    from corpuslens.sources import files

    rows = inventory.keep_files(inventory.file_facts(inventory.detect_language(files.located(binary, folder))))
    return rows.withColumn("file_id", F.sha2(F.concat_ws("|", "repository_id", "path"), 256))


def ingest_stream(spark, folder: str, out: str, checkpoint: str, pattern: str = "*"):
    """New files under folder go through inventory, parsing and chunking as they come, into tables files, symbols, imports, errors and chunks below out.

    A micro-batch writes partitions of its own number, which a repeated batch replaces, and touches no other; `current` gives the rows of
    each file's newest batch. So a batch costs as much as its own files, however many came before. Spark's file source reads a path once; `ingest_changes`
    takes up newer versions of files in the same tables.
    """
    schema = spark.read.format("binaryFile").load(folder).schema
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return stream.writeStream.foreachBatch(lambda batch, number: _ingest(_facts(batch, folder), out, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_changes(spark, folder: str, out: str, pattern: str = "*") -> int:
    """Files under folder that are new or have other contents than the tables below out say are ingested as a further batch; gives their number.

    The state is the tables themselves: the hash of each file's current contents. Only files modified since the pass before (but for a minute, as clocks differ) are read, and
    of these only those whose hash differs are parsed. A pass that fails leaves no trace in `current` and is made again by the next call. Files that vanished keep their rows, and so do files that became empty, which Spark's file sources leave out.
    """
    files_at, log = f"{out}/files", f"{out}/passes"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = lambda p: hadoop(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop(p))
    passes = spark.read.parquet(log).agg(F.max("number").alias("n"), F.max("seen").alias("seen")).first() if there(log) else None
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    if passes:
        since = spark.createDataFrame([(passes["seen"],)], "t timestamp").select(F.date_format(F.col("t") - F.expr("INTERVAL 1 MINUTE"), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
        reader = reader.option("modifiedAfter", since)
    binary = reader.load(folder)
    seen = binary.agg(F.max("modificationTime")).first()[0]
    if seen is None:
        return 0
    rows = _facts(binary, folder)
    if there(files_at):
        known = current(spark, out, "files").select(F.col("file_id").alias("_id"), F.col("content_hash").alias("_hash"))
        rows = rows.join(known, (F.col("file_id") == F.col("_id")) & (F.col("content_hash") == F.col("_hash")), "left_anti")
    number = passes["n"] + 1 if passes else FIRST_PASS
    _ingest(rows, out, number)
    spark.createDataFrame([(number, seen)], "number long, seen timestamp").coalesce(1).write.mode("append").parquet(log)
    return spark.read.parquet(files_at).filter(F.col("batch") == number).count()


def current(spark, out: str, name: str) -> DataFrame:
    """Rows of a table of ingest_stream that belong to the newest batch of their file."""
    newest = spark.read.parquet(f"{out}/files").groupBy("file_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/{name}").join(newest, ["file_id", "batch"]).drop("batch")


def current_graph(spark, out: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all repositories, from the imports of what `current` gives."""
    from corpuslens.operators import graph, resolve

    known = current(spark, out, "files")
    found = resolve.resolve_imports(current(spark, out, "imports"), known)
    return graph.build_graph(known, found.withColumn("ordinal", F.col("import_id")))

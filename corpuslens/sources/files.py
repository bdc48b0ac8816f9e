"""File trees and archives as DataFrames, and sinks for tables."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = "archive string, path string, size_bytes long, content binary, error string"


def located(binary: DataFrame, root: str, repository: str | None = None) -> DataFrame:
    """Rows of the binaryFile source with path relative to root; the repository is the first folder below root, or given."""
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + "/" + root.removeprefix("file:").strip("/") + "/", "")
    repo = F.lit(repository) if repository else F.element_at(F.split(rel, "/"), 1)
    path = rel if repository else F.regexp_replace(rel, "^[^/]*/", "")
    return binary.select(repo.alias("repository_id"), path.alias("path"), F.col("length").alias("size_bytes"), "content")


def scan_tree(spark: SparkSession, root: str, repository: str | None = None) -> DataFrame:
    """All files below root: repository_id, path, size_bytes, content; sort by split(path, '/') for component order."""
    return located(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), root, repository)


def scan_archives(spark: SparkSession, pattern: str) -> DataFrame:
    """A row for each member of each ZIP archive; an unreadable archive gives one row with error."""
    return expand_archives(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern).select("path", "content"))


def expand_archives(archives: DataFrame) -> DataFrame:
    """A row for each member of each ZIP archive of archives (path, content), read one by one; an unreadable archive or member gives one row with error. Null contents give none."""
    rows = lambda *x: pd.DataFrame([x], columns=["archive", "path", "size_bytes", "content", "error"])

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for m in z.infolist():
                            if not m.is_dir():
                                yield rows(name, m.filename, m.file_size, z.read(m), None)
                except (zipfile.BadZipFile, EOFError, RuntimeError, NotImplementedError, zlib.error):
                    yield rows(name, None, None, None, "CORRUPTED_ZIP")

    return archives.filter("content is not null").select("path", "content").mapInPandas(members, MEMBERS)


def insecure_member(name: Column) -> Column:
    from corpuslens.functions.scalars import normalize_path

    norm = normalize_path(name)
    return norm.startswith("..") | norm.startswith("/") | norm.startswith("\\") | name.contains("../") | name.contains("..\\")


def archive_violations(members: DataFrame, most_files: int = 50_000, most_bytes: int = 500 * 1024 * 1024) -> DataFrame:
    """archive, code, detail of archives to keep out; members: archive, path, archive_bytes (and error)."""
    bad = members.filter(insecure_member(F.col("path"))).groupBy("archive").agg(F.min("path").alias("detail")).select("archive", F.lit("PATH_TRAVERSAL_DETECTED").alias("code"), "detail")
    n = members.groupBy("archive").agg(F.count("path").alias("n"), F.max("archive_bytes").alias("b"), *([F.max("error").alias("e")] if "error" in members.columns else [F.lit(None).cast("string").alias("e")]))
    rows = [
        n.filter(F.col("n") > most_files).select("archive", F.lit("TOO_MANY_FILES").alias("code"), F.col("n").cast("string").alias("detail")),
        n.filter(F.col("b") > most_bytes).select("archive", F.lit("PAYLOAD_TOO_LARGE").alias("code"), F.col("b").cast("string").alias("detail")),
        n.filter(~F.lower("archive").endswith(".zip")).select("archive", F.lit("INVALID_FILE_TYPE").alias("code"), F.col("archive").alias("detail")),
        n.filter("e is not null").select("archive", F.col("e").alias("code"), F.col("archive").alias("detail")),
    ]
    out = bad
    for r in rows:
        out = out.unionByName(r)
    return out


def replace_partitions(df: DataFrame, path: str, name: str = "repository_id", value: Column | None = None) -> None:
    """Writes df as Parquet partitioned by a column; partitions that df has rows of are replaced, others stay."""
    df = df if value is None else df.withColumn(name, value)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)


def clear_partitions(gone: DataFrame, path: str, name: str = "repository_id") -> int:
    """Removes the files of a Parquet table whose partition gone names; gives their number. Only names of files of these partitions reach the driver."""
    spark = gone.sparkSession
    table = spark.read.parquet(path)
    keys = gone.select(F.col(name).cast("string").alias("_gone")).distinct()
    rows = table.select(F.col(name).cast("string").alias("_own"), F.col("_metadata.file_path").alias("_file"))
    found = [r[0] for r in rows.join(keys, F.col("_own") == F.col("_gone"), "left_semi").select("_file").distinct().collect()]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for f in found:
        if not f.endswith(".parquet"):
            raise ValueError(f"no file of a table: {f}")
        place = hadoop(spark.sparkContext._jvm.java.net.URI(f))
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, False)
    return len(found)


def append_messages(messages: DataFrame, sessions: DataFrame, path: str) -> DataFrame:
    """Messages written behind those that are there, by session; gives back the sessions with their titles."""
    none = F.array().cast("array<struct<path:string,start_line:int,end_line:int,symbol_name:string>>")
    rows = messages if "sources" in messages.columns else messages.withColumn("sources", none)
    rows.withColumn("sources", F.coalesce("sources", none)).write.mode("append").partitionBy("session_id").parquet(path)
    return titled(sessions)


def titled(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("title", F.coalesce("title", F.lit("New Chat Session")))


def event_json(events: DataFrame, *columns: str) -> DataFrame:
    """key and value (JSON) of events, as message sinks take them."""
    return events.select(F.col("repo_id").cast("string").alias("key"), F.to_json(F.struct(*columns)).alias("value"))


def read_events(frames: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON frames (value); frames that aren't valid are left out."""
    return frames.select(F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e")).filter("e is not null and e._bad is null").select("e.*").drop("_bad")


def progress_sink(events: DataFrame, path: str, checkpoint: str):
    """A stream of progress events as lines of JSON, in folders by batch and key. A repeated batch replaces its own folders, so each event is written once."""

    def each(batch: DataFrame, number: int) -> None:
        rows = event_json(batch, "repo_id", "status", "progress", "phase", "error_message").withColumn("batch", F.lit(number))
        rows.select("value", "batch", "key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "key").text(path)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_detail(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each file with its symbols by start line, its text, or the reason for none."""
    lists = symbols.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start_line", "name", "kind", "end_line"))).alias("symbols"))
    out = files.join(lists, "file_id", "left")
    error = F.when(F.col("is_binary"), "Binary file — no content preview").when(F.col("content").isNull(), "File source not found on disk")
    return out.withColumns({"content": F.when(~F.col("is_binary"), F.col("content")), "content_error": error, "symbols": F.coalesce("symbols", F.array().cast(lists.schema["symbols"].dataType))})

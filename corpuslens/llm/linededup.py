"""Line dedup by overlapping windows of three lines.

Each window of `width` consecutive lines of a document is hashed to 128 bits. A window that occurs more than once in the table
has a first occurrence, by document id and then by line; every later occurrence is covered, the covered lines of overlapping
windows are merged, and covered lines are removed from their documents.

Documents of fewer lines than a window have none and stay as they are; so do null and empty texts. Lines are compared whole and
exactly, empty ones too, but a window without any word never counts. Of repeated rows with one id, all share what is removed:
occurrences at the same line of the same id are one. Rows without an id stay as they are. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def windows(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """_key, _at (the first line's number, from 0), and the hash _h, _g of each window with a word in it."""
    lines = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.split(F.col(text), "\n", -1).alias("_lines")).filter(F.size("_lines") >= width)
    at = F.explode(F.sequence(F.lit(0), F.size("_lines") - F.lit(width))).alias("_at")
    run = F.array_join(F.slice("_lines", F.col("_at") + 1, width), "\n")
    return lines.select("_key", "_lines", at).select("_key", "_at", run.alias("_run")).filter(F.col("_run").rlike(r"[^\x20\x09-\x0D]")).select("_key", "_at", F.xxhash64("_run").alias("_h"), F.xxhash64(F.lit("second"), "_run").alias("_g"))


def covered(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """_key and _gone, the sorted numbers of the lines that later occurrences cover.

    Counts and first occurrences are summed up before the shuffle. The join back to the windows can be split where one window
    is very frequent; it carries ids and numbers alone, no text.
    """
    found = windows(df, key, text, width)
    first = found.groupBy("_h", "_g").agg(F.min(F.struct("_key", "_at")).alias("_first"), F.max(F.struct("_key", "_at")).alias("_last")).filter("_first <> _last").select("_h", "_g", "_first")
    later = found.join(first, ["_h", "_g"]).filter(F.struct("_key", "_at") != F.col("_first"))
    return later.groupBy("_key").agg(F.collect_set("_at").alias("_starts")).select(
        "_key", F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.sequence(s, s + (width - 1))))).alias("_gone")
    )


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """df with the covered lines removed from text, and _n_gone, how many went (in place of a column of that name).

    A row travels as one struct, so its columns can have any names.
    """
    gone = covered(df, key, text, width)
    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("_row"), df[key].alias("_id"), df[text].alias("_text"))
    lines = F.split("_text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    shorter = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    out = rows.join(gone, rows["_id"] == gone["_key"], "left")
    new = F.when(F.col("_gone").isNotNull(), shorter).otherwise(F.col("_text"))
    row = F.col("_row")
    return out.select(*(new.alias(c) if c == text else row[c].alias(c) for c in df.columns if c != "_n_gone"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_n_gone"))


def drop_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", width: int = 3) -> DataFrame:
    """df's own columns after dedup; documents of which every line went are dropped. n_chars, where df has it, is counted anew."""
    told = df.withColumnRenamed("_n_gone", "_n_gone_before")
    out = dedup(told, key, text, width).filter((F.col("_n_gone") == 0) | (F.col(text).rlike(r"[^\x20\x09-\x0D]"))).drop("_n_gone").withColumnRenamed("_n_gone_before", "_n_gone")
    if n_chars in df.columns:
        out = out.withColumn(n_chars, F.char_length(text).cast(df.schema[n_chars].dataType))
    return out

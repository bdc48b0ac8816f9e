"""Files cut into chunks: one for each symbol, or windows of lines. Row-local array expressions; nothing is shuffled but for the symbols' join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import scalars

MAX_CHARS, WINDOW, OVERLAP, SPLIT = 8000, 50, 10, 100


def line_windows(lines: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Windows of an array of lines: structs of start_line, end_line (from 1) and body."""
    n = F.size(lines)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap)))
    return F.transform(
        starts, lambda p: F.struct((p + 1).alias("start_line"), F.least(p + size, n).alias("end_line"), F.array_join(F.slice(lines, p + 1, F.lit(size)), "\n").alias("body"))
    )


def split_oversized(lines: Column, start: Column, every: int = SPLIT) -> Column:
    """Segments of a symbol's lines at inner definitions, or else every `every` lines."""
    n = F.size(lines)
    found = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i < n) & F.coalesce(F.ltrim(F.get(lines, i)).rlike(r"^(?:def |async def |class )"), F.lit(False)))
    fixed = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(every))
    bounds = F.when(F.size(found) > 0, F.concat(F.array(F.lit(0)), found)).otherwise(fixed)
    ends = F.concat(F.slice(bounds, F.lit(2), F.size(bounds)), F.array(n))
    return F.transform(
        F.arrays_zip(bounds.alias("a"), ends.alias("b")),
        lambda x: F.struct((start + x["a"]).alias("start_line"), (start + x["b"] - 1).alias("end_line"), F.array_join(F.slice(lines, x["a"] + 1, x["b"] - x["a"]), "\n").alias("body")),
    )


def symbol_lines(lines: Column, start: Column, stop: Column) -> Column:
    s, e = F.greatest(F.lit(1), start), F.least(F.size(lines), stop)
    return F.when(e >= s, F.slice(lines, s, e - s + 1)).otherwise(F.array().cast("array<string>"))


def chunk_files(files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Chunks of files (repository_id, file_id, path, content), by symbols (file_id, symbol_id, name, start_line, end_line) where a file has any."""
    blank = ~F.coalesce(F.col("content"), F.lit("")).rlike(r"[^\s\x1c-\x1f\x85]")
    base = files.filter(~blank).select("repository_id", "file_id", "path", scalars.split_lines(F.col("content")).alias("_lines"))
    names = ("repository_id", "file_id", "path", "start_line", "end_line", "chunk_type", "symbol_id", "content")
    window = base
    parts = []
    if symbols is not None:
        lists = symbols.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "name", "symbol_id"))).alias("_symbols"))
        both = base.join(lists, "file_id", "left")
        one = both.filter("_symbols is not null").select("repository_id", "file_id", "path", "_lines", F.explode("_symbols").alias("_s"))
        s, body = F.greatest(F.lit(1), F.col("_s.start_line")), symbol_lines(F.col("_lines"), F.col("_s.start_line"), F.col("_s.end_line"))
        header = scalars.chunk_header(F.col("path"), F.col("_s.name"))
        whole = F.struct(s.alias("start_line"), F.least(F.size("_lines"), F.col("_s.end_line")).alias("end_line"), F.array_join(body, "\n").alias("body"))
        pieces = F.when(F.char_length(header) + F.char_length(whole["body"]) <= MAX_CHARS, F.array(whole)).otherwise(split_oversized(body, s))
        cut = one.select("*", F.explode(pieces).alias("_c"))
        parts.append(cut.withColumns({"start_line": F.col("_c.start_line"), "end_line": F.col("_c.end_line"), "chunk_type": F.lit("symbol"), "symbol_id": F.col("_s.symbol_id"), "content": F.concat(header, F.col("_c.body"))}).select(*names))
        window = both.filter("_symbols is null")
    cut = window.select("repository_id", "file_id", "path", F.explode(line_windows(F.col("_lines"))).alias("_c"))
    kind = "string" if symbols is None else symbols.schema["symbol_id"].dataType
    parts.append(
        cut.withColumns({"start_line": F.col("_c.start_line"), "end_line": F.col("_c.end_line"), "chunk_type": F.lit("block"), "symbol_id": F.lit(None).cast(kind), "content": F.concat(scalars.chunk_header(F.col("path")), F.col("_c.body"))}).select(*names)
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

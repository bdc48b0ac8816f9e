"""Inventory of repositories: language, ignore rules, statistics, upserts. `files` has repository_id and path at least."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions import scalars


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def detect_language(files: DataFrame, fallback: bool = False) -> DataFrame:
    """files with language: by whole name, then by suffix; with fallback, by lexer name over the distinct names that are left.

    The two maps are fixed, so they are literals in the plan and no join is needed.
    """
    out = files.withColumn("language", F.coalesce(_lookup(rules.LANGUAGE_BY_NAME, scalars.basename(F.col("path"))), _lookup(rules.LANGUAGE_BY_SUFFIX, scalars.suffix(F.col("path")))))
    if not fallback:
        return out
    left = out.filter(F.col("language").isNull() & F.col("path").isNotNull()).select(scalars.basename(F.col("path")).alias("_name")).distinct()

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pygments.lexers import guess_lexer_for_filename
        from pygments.util import ClassNotFound

        def one(name: str) -> str | None:
            try:
                lexer = guess_lexer_for_filename(name, "").name
            except ClassNotFound:
                return None
            return None if "text" in lexer.lower() else lexer

        for b in batches:
            yield b.assign(_guess=[one(n) for n in b["_name"]])

    guessed = left.mapInPandas(guess, "_name string, _guess string")
    return out.join(guessed, scalars.basename(F.col("path")) == F.col("_name"), "left").withColumn("language", F.coalesce("language", "_guess")).drop("_name", "_guess")


def ignored_by_gitignore(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """files with ignored. patterns: repository_id, position and line of each repository's ignore file.

    Patterns become regular expressions once for each distinct line; the last pattern that matches a path decides.
    """
    lines = patterns.select("line").distinct().filter("line is not null and trim(line) <> '' and not line like '#%'")

    def translate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bare = [x.rstrip() for x in b["line"]]
            yield b.assign(negated=[x.startswith("!") for x in bare], regex=[scalars.glob_regex(x.removeprefix("!").removeprefix("\\")) for x in bare])

    rows = patterns.join(lines.mapInPandas(translate, "line string, negated boolean, regex string"), "line").select("repository_id", "position", "negated", "regex")
    hits = files.select("repository_id", "path").join(rows, "repository_id").filter("path rlike regex")
    last = hits.groupBy("repository_id", "path").agg(F.max_by(~F.col("negated"), "position").alias("ignored"))
    return files.join(last, ["repository_id", "path"], "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))


def keep_files(files: DataFrame) -> DataFrame:
    return files.filter(~scalars.ignored_by_name(F.col("path")) & ~scalars.ignored_by_glob(F.col("path")))


def file_facts(files: DataFrame) -> DataFrame:
    """files with size_bytes, content_hash, line_count and is_binary of content."""
    binary = scalars.is_binary(F.col("content"))
    return files.withColumns(
        {
            "size_bytes": F.octet_length("content").cast("long"), "content_hash": scalars.content_hash(F.col("content")),
            "line_count": F.when(binary, F.lit(0)).otherwise(scalars.line_count(F.col("content").cast("string"))).cast("long"), "is_binary": binary,
        }
    )


def language_stats(files: DataFrame) -> DataFrame:
    """repository_id, language, lines: of text files with a language."""
    return files.filter(~F.col("is_binary") & F.col("language").isNotNull()).groupBy("repository_id", "language").agg(F.sum("line_count").alias("lines"), F.min(F.split("path", "/")).alias("first_path"))


def primary_language(files: DataFrame) -> DataFrame:
    """repository_id and the code language with the most lines; of equals, the one that comes first by path components."""
    stats = language_stats(files).filter(~F.col("language").isin(*rules.NOT_CODE))
    first = F.row_number().over(Window.partitionBy("repository_id").orderBy(F.desc("lines"), "first_path", "language"))  # a row for each language
    best = stats.withColumn("_k", first).filter("_k = 1").select("repository_id", F.col("language").alias("primary_language"))
    return files.select("repository_id").distinct().join(best, "repository_id", "left")


def register_repositories(files: DataFrame) -> DataFrame:
    """A row for each repository_id with its slug, size and file count."""
    sums = files.groupBy("repository_id").agg(F.sum("size_bytes").alias("size_bytes"), F.count("*").alias("file_count"))
    return sums.withColumns({"slug": scalars.slugify_repo(F.col("repository_id"), F.substring(F.sha2(F.col("repository_id"), 256), 1, 8)), "source": F.lit("upload"), "status": F.lit("pending")})


def top_directory_name(files: DataFrame, default: str = "repository") -> DataFrame:
    """repository_id and the name of its only top directory that isn't hidden, or `default`; files beside it and hidden directories don't count."""
    parts = F.split("path", "/")
    top = F.when((F.size(parts) > 1) & ~F.get(parts, F.lit(0)).startswith("."), F.get(parts, F.lit(0)))
    sums = files.groupBy("repository_id").agg(F.min(top).alias("a"), F.max(top).alias("b"))
    return sums.select("repository_id", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(default).alias("top_name"))


def upsert_files(existing: DataFrame, scanned: DataFrame, keys: tuple[str, ...] = ("repository_id", "path")) -> DataFrame:
    """Scanned values where a file was scanned, else existing ones; files that were not scanned stay."""
    values = [c for c in existing.columns if c not in keys]
    a = existing.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in values), F.lit(True).alias("_had"))
    b = scanned.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in values), F.lit(True).alias("_got"))
    out = a.join(b, list(keys), "full_outer")
    action = F.when(F.col("_had").isNull(), "insert").when(F.col("_got").isNull(), "keep").otherwise("update")
    return out.select(*keys, *(F.when(F.col("_got"), F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(c) for c in values), action.alias("action"))


def delete_repository(table: DataFrame, gone: DataFrame) -> DataFrame:
    """table without the rows of the repositories in gone."""
    return table.join(gone.select("repository_id").distinct(), "repository_id", "left_anti")


#: References between the tables: (table, column, the table that it points to, what happens to a row whose target goes). All targets have the key `id`.
REFERENCES = (
    ("code_file", "repository_id", "repository", "cascade"), ("symbol", "file_id", "code_file", "cascade"), ("symbol", "repository_id", "repository", "cascade"), ("dependency", "repository_id", "repository", "cascade"),
    ("dependency", "from_file_id", "code_file", "cascade"), ("dependency", "to_file_id", "code_file", "set null"), ("code_chunk", "file_id", "code_file", "cascade"), ("code_chunk", "repository_id", "repository", "cascade"),
    ("code_chunk", "symbol_id", "symbol", "set null"), ("repository_graph", "repository_id", "repository", "cascade"), ("analysis_job", "repository_id", "repository", "cascade"), ("chat_session", "repository_id", "repository", "cascade"),
    ("chat_message", "session_id", "chat_session", "cascade"),
)


def _in_order(tables: dict[str, DataFrame], references: tuple) -> list[str]:
    """The tables, each behind those that its rows go with."""
    order: list[str] = []
    while len(order) < len(tables):
        free = [t for t in tables if t not in order and all(of in order or of not in tables for table, _, of, action in references if table == t and action == "cascade" and of != t)]
        if not free:
            raise ValueError("the cascades go round in a circle")
        order += free
    return order


def delete_cascade(tables: dict[str, DataFrame], table: str, ids: DataFrame, references: tuple = REFERENCES) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the tables after the rows of `table` with the ids went, the ids that it doesn't have with their error).

    Rows that point to a row that goes go with it, or lose the reference, as `references` says; tables are walked from targets to what points to them. The ids that go
    are distinct keys, so deleting is an anti-join and clearing a left join on them. Null references point to nothing. Tables that are not given are left out.
    """
    wanted = ids.select(F.col("id")).filter("id is not null").distinct()
    going: dict[str, DataFrame] = {table: wanted.join(tables[table].select("id").distinct(), "id", "left_semi")}
    missing = wanted.join(tables[table].select("id").distinct(), "id", "left_anti").select("id", F.lit(f"{table.upper()}_NOT_FOUND").alias("error"))
    order = _in_order(tables, references)
    for name in order:
        parts = [going[name]] if name in going else []
        for child, column, of, action in references:
            if child == name and action == "cascade" and of in going and "id" in tables[name].columns:
                parts.append(tables[name].join(going[of].select(F.col("id").alias("_gone")), F.col(column) == F.col("_gone"), "left_semi").select("id"))
        if parts:
            going[name] = reduce(DataFrame.unionByName, parts).distinct()
    out = {}
    for name in order:
        left = tables[name]
        if name in going and "id" in left.columns:
            left = left.join(going[name].select(F.col("id").alias("_gone")), F.col("id") == F.col("_gone"), "left_anti")
        for child, column, of, action in references:
            if child == name and of in going:
                target = going[of].select(F.col("id").alias("_gone"))
                if action == "set null":
                    left = left.join(target, F.col(column) == F.col("_gone"), "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone")
                elif "id" not in left.columns:
                    left = left.join(target, F.col(column) == F.col("_gone"), "left_anti")
        out[name] = left
    return out, missing


def directory_tree(files: DataFrame) -> DataFrame:
    """A row for each path prefix: repository_id, path, parent, name, is_file, depth, file_count and lines below; children sort by (is_file, name)."""
    parts = F.split("path", "/")
    each = files.select("repository_id", parts.alias("_p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"), "line_count")
    node = each.select("repository_id", F.array_join(F.slice("_p", F.lit(1), F.col("depth")), "/").alias("path"), "depth", (F.col("depth") == F.size("_p")).alias("is_file"), "line_count")
    out = node.groupBy("repository_id", "path", "depth", "is_file").agg(F.count("*").alias("file_count"), F.sum("line_count").alias("lines"))
    return out.withColumns({"name": scalars.basename(F.col("path")), "parent": F.when(F.col("depth") > 1, F.regexp_replace("path", r"/[^/]*$", ""))})

"""Imports resolved to files of the same repository: candidates with a priority, an equi-join, and the first hit."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.functions import scalars


def is_stdlib(module: Column) -> Column:
    return F.split(module, r"\.")[0].isin(*sorted(sys.stdlib_module_names))


def import_base(path: Column, relative: Column, from_path: Column) -> Column:
    """The path, without ending, that an import asks for."""
    folder = scalars.parent_path(from_path)
    dotted = path.startswith(".") & ~path.startswith("./") & ~path.startswith("../")
    dots = F.char_length(F.regexp_extract(path, r"^\.+", 0))
    rest = F.replace(F.substring(path, dots + 1, F.char_length(path)), F.lit("."), F.lit("/"))
    # ups never lead above the repository's root: parents of the root are the root
    depth = F.when(folder == ".", F.lit(0)).otherwise(F.size(F.split(folder, "/")))
    ups = F.array_join(F.array_repeat(F.lit(".."), F.least(dots - 1, depth)), "/")
    by_dots = F.concat_ws("/", folder, F.when(ups != "", ups), F.when(rest != "", rest))
    joined = F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", folder, path))
    inside = F.when(dotted, by_dots).otherwise(joined)
    return F.ltrim(scalars.normalize_path(F.when(relative, inside).otherwise(F.replace(path, F.lit("."), F.lit("/")))), F.lit("/"))


def resolve_imports(imports: DataFrame, files: DataFrame, mode: str = "reference") -> DataFrame:
    """imports with to_file_id and dependency_type.

    imports: import_id, repository_id, from_path, from_language, import_name, import_path, is_relative. files: repository_id, path, file_id. In mode
    `module`, an import that isn't found is tried once more without its last name.
    """
    path = F.col("import_path")
    relative = F.col("is_relative") | path.startswith(".")
    stdlib = ~relative & (F.col("from_language") == "Python") & is_stdlib(path)
    bases = [import_base(path, relative, F.col("from_path"))]
    if mode == "module":
        bases.append(import_base(F.regexp_replace(path, r"(?<=[^.])\.[^./]+$", ""), relative, F.col("from_path")))
    ends = F.array(*(F.lit(x) for x in rules.IMPORT_ENDINGS))

    def with_endings(base: Column) -> Column:
        return F.transform(ends, lambda e: F.concat(base, e))

    tried = F.posexplode(F.flatten(F.array(*map(with_endings, bases)))).alias("_k", "path")
    asked = imports.withColumns({"_relative": relative, "_stdlib": F.coalesce(stdlib, F.lit(False))})
    hits = asked.filter(~F.col("_stdlib")).select("import_id", "repository_id", tried).join(files.select("repository_id", "path", "file_id"), ["repository_id", "path"])
    first = hits.groupBy("import_id").agg(F.min_by("file_id", "_k").alias("to_file_id"))
    kind = F.when(F.col("_relative"), "internal").when(F.col("_stdlib"), "stdlib").when(F.col("to_file_id").isNotNull(), "internal").otherwise("external")
    return asked.join(first, "import_id", "left").withColumn("dependency_type", kind).drop("_relative", "_stdlib")

"""Symbols and imports of source files. files: file_id, repository_id, path, language, content (text)."""

from __future__ import annotations

import ast
import functools
import multiprocessing
import os
from collections.abc import Callable, Iterator
from multiprocessing.connection import Connection

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .scripts import parse_script

SYMBOL = "struct<name:string,kind:string,start_line:int,end_line:int,signature:string,docstring:string,is_exported:boolean>"
IMPORT = "struct<import_name:string,import_path:string,is_relative:boolean>"
PARSED = f"file_id string, symbols array<{SYMBOL}>, imports array<{IMPORT}>, parse_error string"


def _signature(f: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    a = f.args
    shown = [(("", x) if x is not None else None) for x in a.args] + [("*", a.vararg), ("**", a.kwarg)]
    args = [f"{mark}{x.arg}" + (f": {ast.unparse(x.annotation)}" if x.annotation else "") for mark, x in shown if x is not None]
    kind = "async def" if isinstance(f, ast.AsyncFunctionDef) else "def"
    return f"{kind} {f.name}({', '.join(args)})" + (f" -> {ast.unparse(f.returns)}" if f.returns else "")


def parse_python(source: str) -> tuple[list[tuple], list[tuple], str | None]:
    """Symbols, imports and error of a Python text."""
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        return [], [], f"SyntaxError: {e.msg} at line {e.lineno}"
    except (ValueError, RecursionError, MemoryError) as e:
        return [], [], f"ParseError: {e}"
    symbols: list[tuple] = []
    imports: list[tuple] = []
    exports: set[str] | None = None
    todo: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while todo:  # depth first, in the order of the text
        node, owner = todo.pop()
        if isinstance(node, ast.Import):
            imports += [(x.asname or x.name, x.name, False) for x in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports += [(x.asname or x.name, f"{node.module}.{x.name}" if node.module else x.name, node.level > 0) for x in node.names]
        elif isinstance(node, ast.Assign) and isinstance(node.value, ast.List | ast.Tuple | ast.Set) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets):
            exports = {x.value for x in node.value.elts if isinstance(x, ast.Constant) and isinstance(x.value, str)}
        elif isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            public = node.name in exports if exports is not None else not (node.name.startswith("_") and not (node.name.startswith("__") and node.name.endswith("__")))
            place = (node.lineno, node.end_lineno or node.lineno)
            if isinstance(node, ast.ClassDef):
                bases = ", ".join(map(ast.unparse, node.bases))
                symbols.append((node.name, "class", *place, f"class {node.name}({bases})" if bases else f"class {node.name}", ast.get_docstring(node), public))
                owner = node.name
            else:
                symbols.append((f"{owner}.{node.name}" if owner else node.name, "method" if owner else "function", *place, _signature(node), ast.get_docstring(node), public))
        todo += [(x, owner) for x in reversed(list(ast.iter_child_nodes(node)))]
    return symbols, imports, None


BUDGET = 10.0


class Watched:
    """A parser that runs in a child process of the worker. A text that takes longer than `seconds`, or ends the process, costs that text alone."""

    def __init__(self, parser: Callable[[str], tuple[list, list, str | None]], seconds: float = BUDGET):
        self.parser, self.seconds, self.child = parser, seconds, None

    def _serve(self, mine: Connection, theirs: Connection) -> None:
        theirs.close()  # so that the parent's end is the only one, and its death ends this process
        while True:
            try:
                text = mine.recv()
            except EOFError:
                os._exit(0)
            try:
                mine.send(self.parser(text))
            except Exception as e:  # noqa: BLE001  a plug-in may fail in any way; the row says so
                mine.send(([], [], f"ParseError: {e}"))

    def stop(self) -> None:
        if self.child:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            self.child = None

    def start(self) -> None:
        fork = multiprocessing.get_context("fork")
        self.pipe, far = fork.Pipe()
        self.child = fork.Process(target=self._serve, args=(far, self.pipe), daemon=True)
        self.child.start()
        far.close()

    def __call__(self, text: str) -> tuple[list, list, str | None]:
        if self.child is None:
            self.start()
        try:
            self.pipe.send(text)
            if self.pipe.poll(self.seconds):
                return self.pipe.recv()
            error = f"TimeoutError: parsing took over {self.seconds:g} s"
        except (EOFError, OSError):
            error = "ParseError: the parser's process ended"
        self.stop()
        return [], [], error


def extract(files: DataFrame, parser: Callable[[str], tuple[list, list, str | None]] = parse_python, seconds: float = BUDGET) -> DataFrame:
    """file_id, symbols, imports, parse_error of each file, by a parser of one text. An error, a crash or a text that takes over `seconds` marks that file alone."""

    out = to_arrow_schema(files.sparkSession.createDataFrame([], PARSED).schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        watched = Watched(parser, seconds)
        watched.start()  # before any text is held, so that its process has no copy of one
        try:
            for b in batches:
                for part in slices(b):
                    got = [(key, *watched(text or "")) for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], f.type) for i, f in enumerate(out)], schema=out)
        finally:
            watched.stop()

    return files.select(F.col("file_id").cast("string"), "content").mapInArrow(rows, PARSED)


def slices(batch: pa.RecordBatch, most_bytes: int = 4 << 20, most_rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about most_bytes: what a task holds as Python objects doesn't grow with the batch."""
    step = max(1, min(most_rows, int(batch.num_rows * most_bytes / max(1, batch.nbytes))))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def extract_scripts(files: DataFrame, typed: bool = True, seconds: float = BUDGET) -> DataFrame:
    """extract() for TypeScript (typed) or JavaScript files. Elements in place of values are read in JavaScript and in files whose path ends in x."""
    parts = [(files, not typed)]
    if typed and "path" in files.columns:
        with_tags = F.coalesce(F.lower("path").endswith("x"), F.lit(False))
        parts = [(files.filter(~with_tags), False), (files.filter(with_tags), True)]
    out = [extract(part, functools.partial(parse_script, typed=typed, tags=tags), seconds) for part, tags in parts]
    return functools.reduce(DataFrame.unionByName, out)


def _flat(parsed: DataFrame, column: str) -> DataFrame:
    return parsed.select("file_id", F.explode(column).alias("s")).select("file_id", "s.*")


def script_symbols(files: DataFrame, typed: bool = True) -> DataFrame:
    """Symbols of TypeScript (typed) or JavaScript files, a row each."""
    return _flat(extract_scripts(files, typed), "symbols")


def script_imports(files: DataFrame, required: bool = False) -> DataFrame:
    """file_id, import_name, import_path, is_relative of import statements and, if required (JavaScript), of require calls: a row for each name."""
    return _flat(extract_scripts(files, typed=not required), "imports")


def parse_files(files: DataFrame, seconds: float = BUDGET) -> DataFrame:
    """file_id, symbols, imports, parse_error of all files by language; files of other languages have empty lists and no error."""
    low = F.coalesce(F.lower("language"), F.lit(""))
    text = files.withColumn("file_id", F.col("file_id").cast("string"))
    out = [extract(text.filter(low == "python"), seconds=seconds), extract_scripts(text.filter(low == "typescript"), True, seconds), extract_scripts(text.filter(low == "javascript"), False, seconds)]
    none = lambda kind: F.array().cast(f"array<{kind}>")
    others = text.filter(~low.isin("python", "typescript", "javascript")).select("file_id", none(SYMBOL).alias("symbols"), none(IMPORT).alias("imports"), F.lit(None).cast("string").alias("parse_error"))
    return functools.reduce(DataFrame.unionByName, [*out, others])


def parse_repository(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, imports, errors) of all files by language; files of other languages give none."""
    parsed = parse_files(files)
    return _flat(parsed, "symbols"), _flat(parsed, "imports"), parsed.filter("parse_error is not null").select("file_id", "parse_error")


def of_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports of parse_repository as resolve_imports takes them: with import_id, repository_id, from_path, from_language and from_file_id."""
    own = files.select(F.col("file_id").cast("string").alias("file_id"), "repository_id", F.col("path").alias("from_path"), F.col("language").alias("from_language"))
    rows = imports.distinct().join(own, "file_id").withColumn("from_file_id", F.col("file_id"))
    return rows.withColumn("import_id", F.xxhash64("file_id", "import_path", "import_name", "is_relative"))

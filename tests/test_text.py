from __future__ import annotations

import io
import math
import os
import random
import string
import time
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import chunking, context, frameworks, inventory, parse, resolve, vectors
from corpuslens.operators.scripts import parse_script
from corpuslens.sources import files as sources
from corpuslens.streaming import streams

FILE = "repository_id string, file_id string, path string, content string"


def test_windows(spark):
    n = {"a": 139, "b": 50, "c": 1, "d": 0}
    rows = [("r", k, f"{k}.py", "\n".join(f"l{i}" for i in range(v))) for k, v in n.items()] + [("r", "e", "e.py", " \n \x1c")]
    got = {}
    for r in chunking.chunk_files(spark.createDataFrame(rows, FILE)).collect():
        got.setdefault(r["file_id"], []).append((r["start_line"], r["end_line"]))
        assert r["content"].startswith(f"# File: {r['path']}\n\nl")
    assert {k: sorted(v) for k, v in got.items()} == {"a": [(1, 50), (41, 90), (81, 130), (121, 139)], "b": [(1, 50), (41, 50)], "c": [(1, 1)]}


def test_symbol_chunks(spark):
    big = "class K:\n" + "\n".join(f"    x{i} = '{'y' * 60}'" for i in range(150)) + "\n    def f(self):\n        pass\n    async def g(self):\n        pass"
    flat = "\n".join("z" * 70 for _ in range(250))
    files = spark.createDataFrame([("r", "1", "a.py", "l1\nl2"), ("r", "2", "b.py", big), ("r", "3", "c.py", flat), ("r", "4", "d.py", "one\ntwo")], FILE)
    symbols = spark.createDataFrame([("1", "s1", "f", 1, 999), ("2", "s2", "K", 1, 155), ("3", "s3", "z", 1, 250)], "file_id string, symbol_id string, name string, start_line int, end_line int")
    got = {}
    for r in chunking.chunk_files(files, symbols).collect():
        got.setdefault(r["file_id"], []).append((r["start_line"], r["end_line"], r["symbol_id"]))
    assert {k: sorted(v) for k, v in got.items()} == {"1": [(1, 2, "s1")], "2": [(1, 151, "s2"), (152, 153, "s2"), (154, 155, "s2")], "3": [(1, 100, "s3"), (101, 200, "s3"), (201, 250, "s3")], "4": [(1, 2, None)]}


PYTHON = '''"""Module."""
import os, sys as system
from .calc import add
from pkg import a as b

__all__ = ["Shape", "area"]


@decorated
class Shape(Base, metaclass=M):
    """A shape."""

    def area(self, k: int = 1, *rest, only=2, **more: str) -> float:
        def inner():
            pass
        return 0.0


async def area(x):
    """Area."""


def _hidden():
    def nested():
        pass
'''


def test_python(spark):
    files = spark.createDataFrame([("1", PYTHON), ("2", "def (:"), ("3", ""), ("4", None)], "file_id string, content string")
    got = {r["file_id"]: r for r in parse.extract(files).collect()}
    s = {x["name"]: (x["kind"], x["start_line"], x["end_line"], x["signature"], x["docstring"], x["is_exported"]) for x in got["1"]["symbols"]}
    assert s["Shape"] == ("class", 10, 16, "class Shape(Base)", "A shape.", True)
    assert s["Shape.area"] == ("method", 13, 16, "def area(self, k: int, *rest, **more: str) -> float", None, True)
    assert s["Shape.inner"][0] == "method" and s["nested"][0] == "function" and not s["_hidden"][5]
    assert s["area"][3:] == ("async def area(x)", "Area.", True)
    assert [tuple(x) for x in got["1"]["imports"]] == [("os", "os", False), ("system", "sys", False), ("add", "calc.add", True), ("b", "pkg.a", False)]
    assert got["2"]["parse_error"].startswith("SyntaxError:") and got["3"]["symbols"] == [] and got["4"]["parse_error"] is None
    broken = parse.extract(files, parser=lambda t: 1 / 0).collect()
    assert all(r["parse_error"].startswith("ParseError") for r in broken)


SCRIPT = """import def1, { a as b, c } from './m';
import 'side';
// A shape {
export interface Shape {
  name: string;
}
export type Id = string;
/** Circle. */
export class Circle implements Shape {
  constructor(r: number) {
    this.r = "}";
  }
  async area(): Promise<number> {
    if (this.r) { return 1; }
    return 0;
  }
}
export const twice = (x: number) => {
  return x * 2;
};
function* gen() {
}
"""


def test_scripts(spark):
    files = spark.createDataFrame([("t", SCRIPT), ("j", "const { p, q: r } = require('./n');\nvar h = function () {\n};\nclass A {\n  m() { }\n}\n")], "file_id string, content string")
    got = {(r["file_id"], r["name"]): (r["kind"], r["start_line"], r["end_line"], r["docstring"], r["is_exported"]) for r in parse.script_symbols(files).collect()}
    assert got == {
        ("t", "Shape"): ("interface", 4, 6, "A shape {", True), ("t", "Id"): ("type", 7, 7, None, True), ("t", "Circle"): ("class", 9, 17, "Circle.", True), ("t", "Circle.constructor"): ("method", 10, 12, None, False),
        ("t", "Circle.area"): ("method", 13, 16, None, False), ("t", "twice"): ("function", 18, 20, None, True), ("t", "gen"): ("function", 21, 22, None, False), ("j", "h"): ("function", 2, 3, None, False), ("j", "A"): ("class", 4, 6, None, False), ("j", "A.m"): ("method", 5, 5, None, False),
    }
    names = {(r["import_name"], r["import_path"], r["is_relative"]) for r in parse.script_imports(files, required=True).collect()}
    assert names == {("def1", "./m", True), ("b", "./m", True), ("c", "./m", True), ("side", "side", False), ("p", "./n", True), ("r", "./n", True)}


ODD = r"""
export class Repo<T extends { id: string }> extends Base<{ a: 1 }> implements X {
  private readonly cache = new Map<string, T>();
  static count = 0
  @Input({ a: "}" }) name: string
  handler = (e: Event) => { if (e) { function inner() {} } }
  // doc of get
  get size(): number { return `${this.cache.size} ${ `}` + "{" }`.length }
  abstract foo(): void;
  [Symbol.iterator]() { return /[/}]\/{/g; }
  async *gen<U>(x: U = { a: 1 } as any): AsyncGenerator<{ b: U }> {
    yield x
  }
  #priv(a = ")") {
  }
  static { console.log(1) }
  overload(a: string): void
  overload(a: any) { }
}
namespace N {
  export function inN(a: { x: number }, b = `)}`): { y: number } | undefined {
    function hidden() {}
    return undefined
  }
  type U = | { a: 1 }
    | { b: 2 }
  const z = 1
}
export default function main() { }
declare function sig(a: string): void
function over(a: string): string
function over(a: any) { return a / 2 / 3 }
const a = (x) => x + 1, b = 5,
  c = async function () { }, d = (function () {})()
export const e = async <T,>(x: T): Promise<{ q: T }> => ({ q: x }), f = y =>
  y * 2
const g = (1 + 2) / 3
const k = cond ? (x) => x : null
describe("x", () => {
  const inner2 = () => {}
  function fn() {}
})
if (x) { class InIf { m() {} } }
type Long<T> = T extends string
  ? { a: "};" }
  : never
const obj = { type: 1, class: 2, m() {}, function: 3 }
const t = a
  .b(() => {})
const enum E2 { B }
const last = () => {
  // }
  /* } */
}
"""
WITH_TAGS = r"""import React, { useState } from 'react'
// App
export const App = ({ a }) => {
  const go = () => {}
  return (<div className="it's {" onClick={() => { const inner = () => 1; setX(x < 1) }}>
    Don't {x && <b>{`}`}</b>} // http://x {/* c */}
    <br/> <>frag</>
  </div>)
}
module.exports = { App, k: function () { function deep() {} } }
exports.z = class Zed { run() {} }
const { a, b: { c } = {}, ...rest } = require("./x"), y = require('y')
var v = function named() {}
let s = 'it\'s \
 multi', n = a++ / 2 / w
async function af() {}
"""


def test_odd_scripts():
    typed = {x[0]: (x[1], x[2], x[3]) for x in parse_script(ODD)[0]}
    assert typed == {
        "Repo": ("class", 2, 19), "inner": ("function", 6, 6), "Repo.size": ("method", 8, 8), "Repo.[Symbol.iterator]": ("method", 10, 10), "Repo.gen": ("method", 11, 13), "Repo.#priv": ("method", 14, 15), "Repo.overload": ("method", 18, 18),
        "inN": ("function", 21, 24), "U": ("type", 25, 26), "main": ("function", 29, 29), "over": ("function", 32, 32), "a": ("function", 33, 34), "c": ("function", 33, 34), "e": ("function", 35, 36), "f": ("function", 35, 36),
        "inner2": ("function", 40, 40), "fn": ("function", 41, 41), "InIf": ("class", 43, 43), "InIf.m": ("method", 43, 43), "Long": ("type", 44, 46), "last": ("function", 51, 54),
    }
    symbols, imports, _ = parse_script(WITH_TAGS, typed=False, tags=True)
    assert {x[0]: (x[2], x[3]) for x in symbols} == {"App": (3, 9), "go": (4, 4), "inner": (5, 5), "deep": (10, 10), "Zed": (11, 11), "Zed.run": (11, 11), "v": (13, 13), "af": (16, 16)}
    assert imports == [("React", "react", False), ("useState", "react", False), ("a", "./x", True), ("c", "./x", True), ("rest", "./x", True), ("y", "y", False)]


def made_script(r, depth=0):
    """A random script with the symbols that it must give: (lines, [(name, first line, last line)]), lines counted from 0."""
    lines, found = [], []
    for _ in range(r.randrange(1, 6)):
        n, at = f"x{r.randrange(10**9)}", len(lines)
        noise = [r.choice(["'}'", '"{"', "`}${ {a: '`'}.a }{`", "/[}/]{/", "// }", "/* } \n{ */", "a / b / c", "{ }", "if (a) { }"]) for _ in range(r.randrange(4))]
        body = [x for line in noise for x in (line if "//" in line else f"{line};").split("\n")]
        shape = r.randrange(5)
        if shape == 0:
            lines += [f"function {n}(a = '(', b = {{ c: 1 }}) {{", *body, "}"]
        elif shape == 1:
            lines += [f"const {n} = async (a, b) => {{", *body, "};" if r.random() < 0.5 else "}"]
        elif shape == 2:
            inner = f"m{r.randrange(10**9)}"
            lines += [f"class {n} extends B {{", f"{inner}(x) {{", *body, "}", "field = `}`", "}"]
            found.append((f"{n}.{inner}", at + 1, len(lines) - 3))
        elif shape == 3:
            lines += [f"const {n} = [1,", "2]"]
            continue
        else:
            inner_lines, inner = made_script(r, depth + 1) if depth < 4 else ([], [])
            lines += ["if (a) {", *inner_lines, "}"]
            found += [(x, a + at + 1, b + at + 1) for x, a, b in inner]
            continue
        found.append((n, at, len(lines) - 1))
    return lines, found


@pytest.mark.parametrize("seed", range(40))
def test_made_scripts_have_exact_lines(seed):
    lines, found = made_script(random.Random(seed))
    for typed in (True, False):
        assert sorted((x[0], x[2] - 1, x[3] - 1) for x in parse_script("\n".join(lines), typed)[0]) == sorted(found)


LONG = {
    "string": 'var s = "' + "x\\n" * 330_000 + '";\nfunction f() {\n}\n', "quotes": '"' * 10**6, "templates": "`${" * 300_000, "braces": "{" * 500_000 + ")" * 500_000, "closing": "(" * 500_000 + "}" * 500_000,
    "tags": "x = <a " * 150_000, "slashes": "= /" * 300_000, "imports": "import a\n" * 110_000, "requires": "const x = require(" * 60_000, "constants": "const a = <" * 90_000, "decorators": "class A {" + "@a " * 300_000,
}


@pytest.mark.parametrize("name", LONG)
def test_long_scripts_take_linear_time(name):
    for typed in (True, False):
        began = time.process_time()
        symbols = parse_script(LONG[name], typed, not typed)[0]
        assert time.process_time() - began < 10
    assert name != "string" or [x[:4] for x in symbols] == [("f", "function", 2, 3)]


def test_a_parser_that_hangs_or_dies_costs_one_file(spark):
    def odd(text):
        while text == "hang":
            pass
        if text == "die":
            os._exit(1)
        if text == "raise":
            raise KeyError("no")
        return [(text, "function", 1, 1, "", None, True)], [], None

    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(["a", "hang", "b", "die", "c", "raise", None])], "file_id string, content string").coalesce(1)
    got = {r["file_id"]: ([s["name"] for s in r["symbols"]], r["parse_error"]) for r in parse.extract(files, odd, seconds=1.0).collect()}
    assert got == {"0": (["a"], None), "1": ([], "TimeoutError: parsing took over 1 s"), "2": (["b"], None), "3": ([], "ParseError: the parser's process ended"), "4": (["c"], None), "5": ([], "ParseError: 'no'"), "6": ([""], None)}


CASES = [
    ("app/features/views.py", "Python", "..models.user", True, "app/models/user.py", "internal"), ("src/components/Header.tsx", "TypeScript", "../utils/format", True, "src/utils/format.ts", "internal"),
    ("src/components/Header.tsx", "TypeScript", "axios", False, None, "external"), ("app/features/views.py", "Python", "os.path", False, None, "stdlib"), ("app/features/views.py", "TypeScript", "os", False, None, "external"),
    ("app/features/views.py", "Python", "calc.add", True, None, "internal"), ("app/features/views.py", "Python", "app.models", False, "app/models/__init__.py", "internal"), ("app/features/views.py", "Python", "....x", True, None, "internal"),
    ("main.py", "Python", "./top", False, "top.py", "internal"), ("app/features/views.py", "Python", ".", True, "app/features/__init__.py", "internal"),
]


def test_imports(spark):
    paths = ["app/models/user.py", "app/models/__init__.py", "src/utils/format.ts", "src/utils/format.js", "top.py", "app/features/__init__.py"]
    files = spark.createDataFrame([("r", p, p) for p in paths] + [("other", "os.py", "no")], "repository_id string, path string, file_id string")
    rows = spark.createDataFrame([(i, "r", f, lang, "n", p, rel) for i, (f, lang, p, rel, _, _) in enumerate(CASES)], "import_id int, repository_id string, from_path string, from_language string, import_name string, import_path string, is_relative boolean")
    got = {r["import_id"]: (r["to_file_id"], r["dependency_type"]) for r in resolve.resolve_imports(rows, files).collect()}
    assert got == {i: c[4:] for i, c in enumerate(CASES)}
    more = spark.createDataFrame([(0, "r", "x/y.py", "Python", "f", "app.models.user.f", False)], rows.schema)
    assert resolve.resolve_imports(more, files).first()["dependency_type"] == "external"
    assert resolve.resolve_imports(more, files, mode="module").first()["to_file_id"] == "app/models/user.py"


def test_frameworks(spark):
    rows = [("a", "package.json", '{"dependencies": {"react": "1"}, "devDependencies": {"vite": "2"}, "peerDependencies": {"zzz": "1"}}'), ("a", "requirements.txt", "Django>=4\n# flask\n\nfastapi[all]==1\nnumpy ; x"), ("b", "top/Cargo.toml", "tokio = 1"), ("b", "top/deep/go.mod", "gin-gonic/gin"), ("c", "package.json", "{broken"), ("c", "x/pom.xml", "junit"), ("c", "y/z", "")]
    got = {r["repository_id"]: r["frameworks"] for r in frameworks.frameworks(spark.createDataFrame(rows, "repository_id string, path string, content string")).collect()}
    assert got == {"a": ["Django", "FastAPI", "NumPy", "React", "Vite"], "b": ["Tokio"], "c": []}


def test_contained_items(spark):
    texts = spark.createDataFrame([(1, "say one two three four five six seven eight now"), (2, "xone two three four five six sevenx"), (3, "one two")], "t int, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, "two three"), (3, ""), (4, None)], "i int, item string")
    assert {(r["t"], r["i"]) for r in frameworks.match_contains(texts, items, "text", "item").collect()} == {(1, 1), (2, 1), (1, 2), (2, 2)}


def test_budget_keeps_first_and_all_sources(spark):
    messages = spark.createDataFrame([(1, i, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(9)] + [(2, 0, 0, "user", None)], "session_id int, created_at int, message_id int, role string, content string")
    ranked = spark.createDataFrame([(1, 1, "a", 1, 2, "x" * 400), (1, 2, "b", 1, 2, "y" * 400), (1, 3, "a", 1, 2, "x" * 400)], "question_id int, rank int, path string, start_line int, end_line int, content string")
    got = {r["session_id"]: r for r in context.assemble_prompts(messages, ranked, system="s", max_context=100).collect()}
    assert got[1]["n_blocks"] == 1 and [x["path"] for x in got[1]["sources"]] == ["a", "b"] and [h["content"] for h in got[1]["history"]] == [f"m{i}" for i in range(2, 8)]
    assert "No relevant codebase context found." in got[2]["prompt"] and got[2]["n_blocks"] == 0
    wide = context.assemble_prompts(messages, ranked).filter("session_id = 1").first()
    assert wide["n_blocks"] == 3 and wide["prompt"].count("[Context Item #") == 3
    assert {r["answer"] for r in context.complete(context.assemble_prompts(messages, ranked)).collect()} == {"m8", ""}


def test_embedding_retries_and_failures(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(7)], "i int, content string").coalesce(1)
    rows = vectors.embed(df).collect()
    assert all(len(r["embedding"]) == 64 and not r["embed_failed"] for r in rows)
    flag = str(tmp_path / "asked")

    def flaky(texts):
        import os

        if not os.path.exists(flag):
            open(flag, "w").close()
            raise vectors.RateLimited
        if "text 6" in texts:
            raise ValueError
        return [[1.0, 0.0]] * len(texts)

    got = {r["i"]: (list(r["embedding"]), r["embed_failed"]) for r in vectors.embed(df, provider=flaky, size=2, batch=3, wait=0.01).collect()}
    assert got == {i: ([1.0, 0.0], False) if i < 6 else ([0.0, 0.0], True) for i in range(7)}


def test_search(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.lit("r").alias("repository_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    q = v.filter("chunk_id % 50 = 0").select("repository_id", F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = vectors.nearest(q, v)
    assert all(r["score"] == 1.0 and r["chunk_id"] == r["query_id"] for r in exact.filter("rank = 1").collect())
    indexed, centres = vectors.ivf_index(v, lists=20, rounds=5)
    assert indexed.count() == v.count() and vectors.recall(exact, vectors.ivf_search(q, indexed, centres, probes=14)).first()["recall"] >= 0.9


def test_search_in_blocks_equals_brute_force(spark):
    """Ties, copies, zero vectors, nulls, other lengths, no numbers, repositories without chunks or questions; blocks of any size."""
    some = [[float((i * j) % 7 - 3) for j in range(1, 5)] for i in range(40)]
    odd = [None, [], [0.0] * 4, [1.0, 2.0], [float("nan")] * 4, some[3], some[3]]
    chunks = [(r, f"{r}{i:03}", v) for r in ("a", "b") for i, v in enumerate(some + odd)] + [("d", "d0", some[1])]
    queries = [(r, f"q{r}{i}", v) for r in ("a", "b", "c") for i, v in enumerate([*some[::5], None, [0.0] * 4, [2.0, 1.0]])]

    def cosine(x, y):
        if not x or not y or len(x) != len(y):
            return 0.0
        size = math.sqrt(sum(v * v for v in x)) * math.sqrt(sum(v * v for v in y))
        return sum(v * w for v, w in zip(x, y)) / size if size > 0 else 0.0

    want = set()
    for r, q, x in queries:
        best = sorted((-round(max(0.0, cosine(x, y)), 4), c) for r2, c, y in chunks if r2 == r)[:3]
        want |= {(q, c, -s, i + 1) for i, (s, c) in enumerate(best)}
    qs = spark.createDataFrame(queries, "repository_id string, query_id string, query array<double>")
    cs = spark.createDataFrame(chunks, "repository_id string, chunk_id string, embedding array<double>")
    for rows in ((2000, 8000), (3, 7), (1, 2)):
        got = {(r["query_id"], r["chunk_id"], abs(r["score"]), r["rank"]) for r in vectors.nearest(qs, cs, 3, *rows).collect()}
        assert got == want
    assert vectors.nearest(qs.filter("false"), cs, 3).count() == vectors.nearest(qs, cs.filter("false"), 3).count() == 0


def test_retrieved_context(spark):
    files = spark.createDataFrame([("r", "f1", "a.py", "zebra zebra"), ("r", "f2", "b.py", "moon"), ("s", "f3", "c.py", "zebra")], FILE)
    cut = chunking.chunk_files(files).withColumns({"chunk_id": F.col("file_id"), "symbol_id": F.when(F.col("file_id") == "f1", 7)})
    chunks = vectors.embed(cut)
    asked = spark.createDataFrame([("r", 1, "zebra"), ("r", 2, None), ("t", 3, "zebra")], "repository_id string, question_id int, question string")
    symbols = spark.createDataFrame([(7, "Zoo")], "symbol_id int, name string")
    got = context.retrieve_context(asked, chunks, symbols, k=2).collect()
    assert {(r["question_id"], r["rank"], r["path"], r["symbol_name"]) for r in got} == {(1, 1, "a.py", "Zoo"), (1, 2, "b.py", None), (2, 1, "a.py", "Zoo"), (2, 2, "b.py", None)}
    assert context.retrieve_context(asked, chunks, k=1).filter("symbol_name is not null").count() == 0


def test_index_replaces_by_repository(spark, tmp_path):
    path, rows = str(tmp_path / "index"), [("r", "f1", "a.py", "x\n" * 90, False), ("r", "f2", "b.py", "y", False), ("s", "f3", "c.py", "z", False), ("s", "f4", "d.png", "p", True)]
    frame = lambda x: spark.createDataFrame(x, FILE + ", is_binary boolean")
    assert {tuple(r) for r in vectors.index_repositories(frame(rows), path).collect()} == {("r", 4), ("s", 1)}
    assert {tuple(r) for r in vectors.index_repositories(frame(rows[1:2]), path).collect()} == {("r", 1)}
    blank = frame([("s", "f3", "c.py", " ", False)])  # nothing is left of a repository without a chunk
    assert vectors.index_repositories(blank, path).collect() == [] and {r["repository_id"] for r in spark.read.parquet(path).collect()} == {"r"}


def test_trees_archives_and_sinks(spark, tmp_path):
    root = tmp_path / "in"
    (root / "repo" / "src").mkdir(parents=True)
    (root / "repo" / "src" / "a.py").write_text("x = 1\n")
    (root / "repo" / "node_modules").mkdir()
    (root / "repo" / "node_modules" / "b.js").write_text("y")
    got = sources.scan_tree(spark, str(root))
    assert {(r["repository_id"], r["path"], r["size_bytes"]) for r in got.collect()} == {("repo", "src/a.py", 6), ("repo", "node_modules/b.js", 1)}
    assert [r["path"] for r in inventory.keep_files(got).collect()] == ["src/a.py"]
    zips = tmp_path / "zips"
    zips.mkdir()
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("sample/calc.py", "def f(): pass\n")
        z.writestr("../evil.py", "x")
    (zips / "good.zip").write_bytes(held.getvalue())
    (zips / "bad.zip").write_bytes(b"no zip")
    members = sources.scan_archives(spark, str(zips)).withColumn("archive_bytes", F.lit(10))
    assert {r["code"] for r in sources.archive_violations(members).collect()} == {"PATH_TRAVERSAL_DETECTED", "CORRUPTED_ZIP"}
    assert {r["code"] for r in sources.archive_violations(members, most_files=1, most_bytes=9).collect()} == {"PATH_TRAVERSAL_DETECTED", "CORRUPTED_ZIP", "TOO_MANY_FILES", "PAYLOAD_TOO_LARGE"}
    out = str(tmp_path / "table")
    table = lambda rows: spark.createDataFrame(rows, "repository_id string, x int")
    sources.replace_partitions(table([("a", 1), ("b", 2)]), out)
    sources.replace_partitions(table([("a", 3)]), out)
    assert {(r["repository_id"], r["x"]) for r in spark.read.parquet(out).collect()} == {("a", 3), ("b", 2)}
    told = sources.append_messages(spark.createDataFrame([(1, 1, "hi")], "session_id int, message_id int, content string"), spark.createDataFrame([(1, None), (2, "t")], "session_id int, title string"), str(tmp_path / "m"))
    assert {r["title"] for r in told.collect()} == {"New Chat Session", "t"} and spark.read.parquet(str(tmp_path / "m")).first()["sources"] == []
    streams.ingest_stream(spark, str(root), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r["content"] for r in spark.read.parquet(str(tmp_path / "out" / "chunks")).collect()] == ["# File: src/a.py\n\nx = 1"]


def test_ingest_in_two_batches_equals_one(spark, tmp_path):
    """Files of a later batch leave those of earlier ones alone, and the graph spans batches."""
    root = tmp_path / "tree"
    for name in ("one", "two"):
        (root / name).mkdir(parents=True)
    body = lambda i: f"import m{i - 1}\n\n\ndef f{i}():\n    return {i}\n"
    run = lambda out, cp: streams.ingest_stream(spark, str(root), str(tmp_path / out), str(tmp_path / cp)).awaitTermination()
    for i in range(30):
        (root / "one" / f"m{i}.py").write_text(body(i))
    run("out", "cp")
    for i in range(30, 60):
        (root / "one" / f"m{i}.py").write_text(body(i))
    (root / "two" / "x.js").write_text("import a from './y'\n")
    (root / "two" / "y.js").write_text("/* {\n { */\nfunction g() {\n}\n")
    run("out", "cp")
    run("once", "cp2")
    for name in ("files", "symbols", "imports", "chunks"):
        a, b = (streams.current(spark, str(tmp_path / o), name) for o in ("out", "once"))
        assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0, name
    assert streams.current(spark, str(tmp_path / "out"), "files").count() == 62
    nodes, edges = streams.current_graph(spark, str(tmp_path / "out"))
    assert nodes.count() == 62 and edges.count() == 60  # m0 can't be parsed; x.js asks for y.js
    assert {(r["name"], r["start_line"], r["end_line"]) for r in streams.current(spark, str(tmp_path / "out"), "symbols").filter("name = 'g'").collect()} == {("g", 3, 4)}


def test_changed_files_equal_one_run(spark, tmp_path):
    """New versions under the same tables give what one run over the last tree gives."""
    root, out = tmp_path / "tree", str(tmp_path / "out")
    (root / "r").mkdir(parents=True)
    for i in range(6):
        (root / "r" / f"m{i}.py").write_text(f"import m{i - 1}\n\n\ndef f{i}():\n    pass\n")
    streams.ingest_stream(spark, str(root), out, str(tmp_path / "cp")).awaitTermination()
    (root / "r" / "m1.py").write_text("def other():\n    pass\n")
    (root / "r" / "m2.py").write_text("\n")
    (root / "r" / "m3.py").write_text("def broken(:\n")
    (root / "r" / "m9.py").write_text("import m1\n")
    assert streams.ingest_changes(spark, str(root), out) == 4
    assert streams.ingest_changes(spark, str(root), out) == 0
    (root / "r" / "m3.py").write_text("import m9\n")
    assert streams.ingest_changes(spark, str(root), out) == 1
    assert streams.ingest_changes(spark, str(root), str(tmp_path / "once")) == 7
    for name in ("files", "symbols", "imports", "chunks", "errors"):
        a, b = (streams.current(spark, o, name) for o in (out, str(tmp_path / "once")))
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0, name
    assert {r["name"] for r in streams.current(spark, out, "symbols").collect()} == {"other", "f4", "f5"}
    assert streams.current_graph(spark, out)[1].count() == 4


def test_sink_writes_an_event_once(spark, tmp_path):
    one = spark.createDataFrame([("r", "running", 10, "p", None), ("s", "ready", 100, "q", None)], "repo_id string, status string, progress int, phase string, error_message string")
    one.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = lambda: spark.readStream.schema(one.schema).parquet(str(tmp_path / "in"))
    for checkpoint in ("a", "b"):  # without its checkpoint, the first batch is made again
        sources.progress_sink(live(), str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination()
    got = spark.read.text(str(tmp_path / "out"))
    assert sorted((r["key"], r["value"]) for r in got.collect()) == [("r", '{"repo_id":"r","status":"running","progress":10,"phase":"p"}'), ("s", '{"repo_id":"s","status":"ready","progress":100,"phase":"q"}')]


EVENT = "key string, event_id long, ts timestamp, status string, progress int, phase string"


def test_streams(spark, tmp_path):
    at = lambda s: (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()
    rows = [("a", 1, at(0), "running", 10, "p"), ("a", 2, at(5), "ready", 100, "q"), ("a", 3, at(9), "running", 5, "r"), ("b", 4, at(1), "running", 20, "p"), ("b", 5, at(100), "running", 30, "q"), ("c", 6, at(2), "error", 1, "p")]
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(str(tmp_path / "e"))
    batch = spark.read.parquet(str(tmp_path / "e"))
    want = {("a", "ready", 100), ("b", "running", 30), ("c", "error", 1)}
    assert {(r["key"], r["status"], r["progress"]) for r in streams.progress_batch(batch).collect()} == want
    assert [(r["key"], r["silent"]) for r in streams.stalled_batch(batch).collect()] == [("b", 99.0)]
    live = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "e"))
    got = streams.run_to_table(streams.progress_stream(live), "progress", "update", str(tmp_path / "c1")).collect()
    assert {(r["key"], r["status"], r["progress"]) for r in got} == want
    for part in ([("b", 5, at(100), "running", 30, "q")], [("b", 7, at(90), "ready", 100, "z"), ("b", 8, at(95), "error", 9, "z"), ("b", 9, at(300), "running", 40, "z")]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
    late = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "late"))
    got = streams.run_to_table(streams.progress_stream(late), "late", "update", str(tmp_path / "c0")).collect()
    assert {(r["key"], r["status"], r["progress"]) for r in got} == {("b", "running", 30), ("b", "ready", 100)}  # an end counts, however late it comes
    stalled = streams.run_to_table(streams.progress_stream(live, stall_ms=15_000, lateness="1 second"), "stalled", "update", str(tmp_path / "c2")).collect()
    assert {(r["key"], r["stalled"]) for r in stalled if not r["stalled"]} == {("a", False), ("b", False), ("c", False)}
    assert streams.run_to_table(streams.once_each(live.unionAll(live)), "once", "append", str(tmp_path / "c3")).count() == 6
    calls = spark.createDataFrame([("k", at(i / 2)) for i in range(101)], "client_key string, ts timestamp")
    from corpuslens.operators import metrics

    assert [(r["calls"], r["rejected"]) for r in metrics.rate_violations(calls, 100, "1 minute").collect()] == [(101, 1)]


def test_primary_language_and_summary(spark):
    rows = [("r", "b.py", "Python", "x\n" * 3), ("r", "a.go", "Go", "x\n" * 3), ("r", "c.json", "JSON", "x\n" * 99), ("s", "d.md", "Markdown", "x\n")]
    files = inventory.file_facts(spark.createDataFrame(rows, "repository_id string, path string, language string, content string"))
    assert {r["repository_id"]: r["primary_language"] for r in inventory.primary_language(files).collect()} == {"r": "Go", "s": None}


@pytest.mark.parametrize("number,size", [(0, 5), (1, 0), (1, 101)])
def test_page_bounds(spark, number, size):
    from corpuslens.operators import metrics

    with pytest.raises(ValueError):
        metrics.page(spark.range(5), ["id"], number, size)


def test_contained_items_of_any_length(spark):
    r = random.Random(5)
    words = ["ab", "a", "b", "ba", "c*", "é", "ab.c", "#"]
    texts = [(i, " ".join(r.choices(words, k=r.randrange(30)))) for i in range(80)] + [(80, None), (81, ""), (82, "ab " * 50_000)]
    items = [(i, " ".join(r.choices(words, k=1 + i % 9))) for i in range(90)] + [(90, None), (91, ""), (92, " "), (93, "ab"), (94, "ab"), (95, " a b"), (96, "b\na")]
    want = {(a, b) for a, t in texts for b, x in items if t and x and x.strip() and x in t}
    t, i = spark.createDataFrame(texts, "t int, text string"), spark.createDataFrame(items, "i int, item string")
    for most in (1 << 20, 40):
        got = frameworks.match_contains(t, i, "text", "item", most_chars=most)
        assert sorted((x["t"], x["i"]) for x in got.collect()) == sorted(want)
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_delete_cascade(spark):
    t = {
        "repository": spark.createDataFrame([("r1",), ("r2",)], "id string"), "code_file": spark.createDataFrame([("f1", "r1"), ("f2", "r2"), ("f3", None)], "id string, repository_id string"),
        "symbol": spark.createDataFrame([("s1", "f1", "r1"), ("s2", "f2", "r2"), ("s3", "f1", "r2")], "id string, file_id string, repository_id string"),
        "dependency": spark.createDataFrame([("d1", "r1", "f1", "f2"), ("d2", "r2", "f2", "f1"), ("d3", "r2", "f2", None), ("d4", "r2", "f2", "f2")], "id string, repository_id string, from_file_id string, to_file_id string"),
        "code_chunk": spark.createDataFrame([("c1", "f2", "r2", "s3"), ("c2", "f2", "r2", "s2"), ("c3", "f2", "r1", None)], "id string, file_id string, repository_id string, symbol_id string"),
        "repository_graph": spark.createDataFrame([("r1", "g1"), ("r2", "g2")], "repository_id string, nodes string"),
    }
    left, missing = inventory.delete_cascade(dict(reversed(t.items())), "repository", spark.createDataFrame([("r1",), ("r9",), ("r1",), (None,)], "id string"))
    rows = {k: sorted(map(tuple, v.collect()), key=str) for k, v in left.items()}
    assert rows == {
        "repository": [("r2",)], "code_file": [("f2", "r2"), ("f3", None)], "symbol": [("s2", "f2", "r2")], "dependency": [("d2", "r2", "f2", None), ("d3", "r2", "f2", None), ("d4", "r2", "f2", "f2")],
        "code_chunk": [("c1", "f2", "r2", None), ("c2", "f2", "r2", "s2")], "repository_graph": [("r2", "g2")],
    }
    assert [tuple(r) for r in missing.collect()] == [("r9", "REPOSITORY_NOT_FOUND")]
    assert all(left[k].columns == t[k].columns for k in t)
    one, _ = inventory.delete_cascade(t, "code_file", spark.createDataFrame([("f2",)], "id string"))
    assert {k: v.count() for k, v in one.items()} == {"repository": 2, "code_file": 2, "symbol": 2, "dependency": 1, "code_chunk": 0, "repository_graph": 2}
    with pytest.raises(ValueError, match="circle"):
        inventory.delete_cascade({"a": t["repository"], "b": t["repository"]}, "a", t["repository"], (("a", "id", "b", "cascade"), ("b", "id", "a", "cascade")))


def test_product_quantisation(spark):
    """Clustered and scattered vectors, of a length that the runs don't divide, over two repositories, in several blocks."""
    import numpy as np

    rng = np.random.default_rng(6)
    rows = [("r" if i % 3 else "s", i, [float(x) for x in rng.normal(size=30) + (5 if i % 2 else 0)]) for i in range(900)]
    rows += [("r", 900, [0.0] * 30), ("r", 901, None), ("t", 902, [1.0] * 30)]
    v = spark.createDataFrame(rows, "repository_id string, chunk_id int, embedding array<double>")
    q = spark.createDataFrame([(r, i, x) for r, i, x in rows if i % 45 == 0 or i > 899], "repository_id string, query_id int, query array<double>").filter("query is not null and query_id <> 900")
    books = vectors.pq_books(v, parts=7, codes=200)
    indexed = vectors.pq_index(v, books)
    assert indexed.count() == 901 and [b.shape[1] for b in books] == [5, 5, 4, 4, 4, 4, 4]
    found, exact = vectors.pq_search(q, v, indexed, books, refine=15), vectors.nearest(q, v)
    assert vectors.recall(exact.filter("chunk_id < 900"), found).first()["recall"] >= 0.9
    want = {(r["query_id"], r["chunk_id"]): r["score"] for r in exact.collect()}
    assert all(want.get((r["query_id"], r["chunk_id"]), r["score"]) == r["score"] for r in found.collect())
    small = vectors.pq_candidates(q, indexed, books, 20, query_rows=3, chunk_rows=50)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, vectors.pq_candidates(q, indexed, books, 20).collect()))
    assert vectors.pq_books(v.limit(0)) == [] and vectors.pq_index(v.limit(0), books).count() == 0


def test_counts_of_contained_items_need_no_pairs(spark):
    """every text contains every item; what is shuffled grows with the items of a task, not with the pairs, and holds no text."""
    from corpuslens.operators import frameworks

    texts = spark.createDataFrame([("a b c d e f g h " + "x" * (i % 7),) for i in range(400)] + [(None,)], "text string").repartition(2)
    items = spark.createDataFrame([(x,) for x in ("a", "b c", " ", "", "xx", "xx", "b c d e f g h", "nowhere", None)], "item string")
    want = {"a": 400, "b c": 400, "xx": sum(i % 7 > 1 for i in range(400)), "b c d e f g h": 400}
    for most in (1 << 20, 3):
        df = frameworks.count_contained(texts, items, "text", "item", most_chars=most)
        assert {r["item"]: r["n"] for r in df.collect()} == want
    plan = frameworks.count_contained(texts, items, "text", "item")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert frameworks.count_contained(texts, items.filter("false"), "text", "item").count() == frameworks.match_contains(texts, items.filter("item = ''"), "text", "item").count() == 0


def test_search_in_cells_equals_brute_force(spark):
    """cells are searched as blocks of matrices; the plan compares no pair of vectors row by row."""
    g = np.random.default_rng(3)
    x, centres = g.normal(size=(300, 6)), g.normal(size=(5, 6))
    x[7] = 0
    cell = g.integers(0, 5, 300)
    v = spark.createDataFrame([("ab"[i % 2], i, x[i].tolist(), int(cell[i])) for i in range(300)], "repository_id string, chunk_id long, embedding array<float>, cell int")
    q = v.filter("chunk_id % 10 < 2").select("repository_id", F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    df = vectors.ivf_search(q, v, centres.tolist(), k=4, probes=2)
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) if a.any() and b.any() else 0.0
    want = set()
    f = x.astype("float32").astype(float)
    for i in range(300):
        if i % 10 < 2:
            near = sorted(range(5), key=lambda c: (-cos(f[i], centres[c]), c))[:2]
            ranked = sorted((-round(max(0.0, cos(f[i], f[j])), 4), j) for j in range(300) if j % 2 == i % 2 and cell[j] in near)[:4]
            want |= {(i, j, k + 1) for k, (_, j) in enumerate(ranked)}
    assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in df.collect()} == want
    assert "zip_with" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_grow_with_the_chunks(spark):
    """with coarse codes and many chunks, a fixed number of candidates misses more than a tenth of the nearest."""
    x = np.random.default_rng(4).normal(size=(4000, 16))
    v = spark.createDataFrame([("all", i, r.tolist()) for i, r in enumerate(x)], "repository_id string, chunk_id long, embedding array<float>")
    q = v.filter("chunk_id % 50 = 0").select("repository_id", F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    books = vectors.pq_books(v, parts=4, codes=16)
    indexed, exact = vectors.pq_index(v, books), vectors.nearest(q, v)
    assert vectors.recall(exact, vectors.pq_search(q, v, indexed, books, refine=2)).first()["recall"] < 0.9
    keep = vectors.pq_keep(q, v, indexed, books, refine=2)
    assert 20 < keep < 1000
    assert vectors.recall(exact, vectors.pq_rank(vectors.pq_candidates(q, indexed, books, keep), q, v)).first()["recall"] >= 0.9
    assert vectors.pq_keep(q.filter("false"), v, indexed, books) == 50


def test_parsing_holds_a_slice_of_a_batch():
    """F7, F8: of a large batch a bounded part becomes Python objects at a time, and no row is lost."""
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"file_id": [str(i) for i in range(5000)], "content": ["x" * 8000] * 5000})
    parts = list(parse.slices(b))
    assert max(p.num_rows for p in parts) <= 530 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([b]))
    assert [p.num_rows for p in parse.slices(b, most_bytes=1)] == [1] * 5000 and not list(parse.slices(b.slice(0, 0)))


def test_embedding_holds_a_request_of_a_batch():
    """of 2000 texts of 40 KB, 100 at a time are Python objects, and the vectors are those of all at once."""
    import tracemalloc

    import pyarrow as pa

    texts = [None, *(string.ascii_lowercase[i % 26] * 40_000 for i in range(1999))]
    held = pa.array(texts)
    want = vectors.letter_counts(texts)
    tracemalloc.start()
    got = vectors._embedded(held, vectors.letter_counts, 26, 100, 5, 0.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x["embedding"] for x in got.to_pylist()] == want and not any(x["embed_failed"] for x in got.to_pylist())
    assert peak < 20e6

from __future__ import annotations

import posixpath
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import scalars
from corpuslens.operators import inventory


def values(spark, xs, f, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize_path_equals_posix(spark):
    rng = random.Random(1)
    xs = ["".join(rng.choice(["a", "b", "/", "/", ".", ".."]) for _ in range(rng.randint(1, 9))) for _ in range(300)] + ["//a", "///a", "a//b", "/.."]
    assert values(spark, xs, scalars.normalize_path) == [posixpath.normpath(x) for x in xs]


def test_lines(spark):
    xs = ["", "a", "a\n", "a\r\nb", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029", "\n\n", "a\rb\n"]
    assert values(spark, xs, scalars.split_lines) == [x.splitlines() for x in xs]
    assert values(spark, xs, scalars.line_count) == [x.count("\n") for x in xs]


def test_bytes(spark):
    xs = [b"", b"abc", b"a\x00b", b"x" * 8192 + b"\x00", b"x" * 8191 + b"\x00", b"a\xffb\xe2\x82"]
    assert values(spark, xs, scalars.is_binary, "binary") == [False, False, True, False, True, False]
    assert values(spark, xs, scalars.decode_text, "binary") == [x.decode("utf-8", "replace") for x in xs]


def test_urls_names_sizes(spark):
    assert values(spark, ["https://a.org/x", " https://a.org ", "http://a.org", "https:///x", "ftp://a", "HTTPS//", None], scalars.valid_git_url) == [True, True, False, False, False, False, False]
    assert values(spark, ["My Répo!", "--", "a_b"], lambda c: scalars.slugify_repo(c, F.lit("12ab-34"))) == ["my-repo-12ab", "repository-12ab", "a-b-12ab"]
    assert values(spark, ["x/My (repo).zip", ".zip", "!!!.tar.gz"], scalars.clean_name) == ["My repo", "zip", "tar"]
    assert values(spark, [0, 1, 1023, 1024, 1536, 1024**2, 5 * 1024**3], scalars.human_bytes, "long") == ["0 B", "1 B", "1023 B", "1 KB", "1.5 KB", "1 MB", "5 GB"]
    assert values(spark, ["_a", "__a__", "a", "__a"], scalars.is_private_name) == [True, False, False, True]


def test_similarity_and_score(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([], [])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(scalars.cosine_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, -1.0, 0.0, 0.0, 0.0, 0.0]
    assert values(spark, [0.0, 0.25, 1.5, None, float("nan")], scalars.score, "double") == [1.0, 0.75, 0.0, 0.0, 0.0]


def test_stage_states(spark):
    one = lambda phase, status: values(spark, ["ingestion", "parsing", "indexing"], lambda c: scalars.stage_state(c, F.lit(phase), F.lit(status)))
    assert one("parsing", "parsing") == ["done", "active", "pending"]
    assert one("parsing", "error") == ["done", "error", "pending"]
    assert one("parsing", "ready") == ["done"] * 3 and one(None, "pending") == ["pending"] * 3


LANGUAGES = {"main.py": "Python", "a/b.TSX": "TypeScript", "Component.jsx": "JavaScript", "vars.scss": "SCSS", "Makefile": "Makefile", "x/Dockerfile": "Dockerfile", "Gemfile": "Ruby", "a.tar.gz": None, ".gitignore": None, "s.R": "R", "noext": None, "t.d.ts": "TypeScript"}


def test_languages(spark):
    rows = spark.createDataFrame([(k,) for k in LANGUAGES], "path string")
    assert {r["path"]: r["language"] for r in inventory.detect_language(rows).collect()} == LANGUAGES
    guessed = {r["path"]: r["language"] for r in inventory.detect_language(rows.unionByName(spark.createDataFrame([("a/x.tcl",)], "path string")), fallback=True).collect()}
    assert guessed["a/x.tcl"] == "Tcl" and guessed["noext"] is None and guessed["main.py"] == "Python"


GLOBS = [
    ("*.pyc", ["a.pyc", "x/y.pyc", "x.pyc/z"], ["a.py", "a.pycx"]), ("/build", ["build", "build/x"], ["a/build"]), ("docs/", ["docs/x", "a/docs/y"], []), ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["b", "x/a/b"]), ("**/t", ["t", "x/t", "x/t/y"], ["xt"]),
    ("x/**", ["x/y", "x/y/z"], ["x", "a/x/y"]), ("[ab].c", ["a.c", "q/b.c"], ["c.c"]), ("[!ab].c", ["c.c"], ["a.c"]), ("f?o", ["foo", "fxo"], ["fo", "f/o"]), ("\\!x", ["!x"], ["x"]),
]


@pytest.mark.parametrize("glob,yes,no", GLOBS)
def test_globs(glob, yes, no):
    import re

    rx = re.compile(scalars.glob_regex(glob))
    assert [x for x in yes if not rx.search(x)] == [] and [x for x in no if rx.search(x)] == []


def test_gitignore_last_match_wins(spark):
    files = spark.createDataFrame([("r", p) for p in ("a.log", "keep.log", "b.txt", "s/a.log")] + [("q", "a.log")], "repository_id string, path string")
    lines = spark.createDataFrame([("r", 0, "# no"), ("r", 1, "*.log"), ("r", 2, "!keep.log"), ("r", 3, "")], "repository_id string, position int, line string")
    got = {(r["repository_id"], r["path"]): r["ignored"] for r in inventory.ignored_by_gitignore(files, lines).collect()}
    assert got == {("r", "a.log"): True, ("r", "keep.log"): False, ("r", "b.txt"): False, ("r", "s/a.log"): True, ("q", "a.log"): False}

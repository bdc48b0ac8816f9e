from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from corpuslens.llm import filteraudit, queries

from .helpers import clash

DOC = "doc_id long, text string, lang string"
LABEL = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    told = defaultdict(lambda: [False, False])
    for k, q, x in labels:
        told[k][0] |= q == 1
        told[k][1] |= x == 1
    docs = []
    for k, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": k is not None and least[t] < k}
        docs.append((part or "", {f for f, bad in fails.items() if bad}, *(told[k] if k is not None else (False, False))))
    out, shapley = {}, Counter()
    for order in itertools.permutations("ABCDE"):
        for p in {d[0] for d in docs}:
            for s, f in enumerate(order):
                own = [(bad, bool(bad & set(order[:s])), good, toxic) for part, bad, good, toxic in docs if part == p]
                here = [(good, toxic) for bad, gone, good, toxic in own if f in bad and not gone]
                shapley[p, f] += len(here)
                out[p, "".join(order), s + 1] = [
                    sum(f not in bad and not gone for bad, gone, _, _ in own), len(here), sum(f in bad and gone for bad, gone, _, _ in own), sum(bad == {f} for bad, *_ in own), sum(g for g, _ in here), sum(x for _, x in here)
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(spark, rows, labels, *clashing):
    df = clash(spark.createDataFrame(rows, DOC), *clashing)
    out = filteraudit.audit(filteraudit.masks(df, clash(spark.createDataFrame(labels, LABEL), *clashing))).collect()
    return {tuple(r)[:3]: tuple(r)[3:] for r in out}, len(out)


def test_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(120))
    rows = [
        (1, None, "en"), (2, "", "en"), (3, words, "en"), (4, words, None), (5, words, ""), (5, words, "en"), (5, words.upper(), "de"), (6, "same " * 200, "de"), (7, f"{words} #", "de"),
        (None, words, "en"), (None, None, None), (8, f"{words.upper()} * {words.upper()}", "fr"), (9, "x y " * 40_000, "fr"), (9, "x y " * 40_000, "fr"), (10, "x y " * 40_000, "fr"), (11, "É " * 130, "fr"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (4, 1, None), (5, None, 1), (8, 1, 1), (99, 1, 1), (None, 1, 1)]
    got, n = found(spark, rows, labels, "_key", "_h", "part", "mask", "n")
    assert n == len(got) == 4 * 600 and got == brute(rows, labels)
    assert found(spark, [], labels) == ({}, 0)
    assert found(spark, rows, [])[0] == brute(rows, [])


def test_whole_table(spark, sf_dir):
    df, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows, told = [tuple(r) for r in df.select("doc_id", "text", "lang").collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    got = {tuple(r)[:3]: tuple(r)[3:] for r in queries.op12_filter_audit(spark, sf_dir).collect()}
    assert got == brute(rows, told)
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert {x[:3]: x[3:] for x in c.sql(queries.OP12_SQL).fetchall()} == got


@pytest.mark.parametrize("n", [(1 << 40) + 3, 1 << 60])
def test_no_field_runs_over(n):
    total = n * filteraudit.integer(0b10110, True, False, 5) + 7 * filteraudit.integer(0, False, False, 5)
    fields = filteraudit.unpacked(total, 5)
    one = filteraudit.unpacked(filteraudit.integer(0b10110, True, False, 5), 5).astype(object)
    none = filteraudit.unpacked(filteraudit.integer(0, False, False, 5), 5).astype(object)
    assert (fields.astype(object) == n * one + 7 * none).all()
    assert fields.shape == (600, 6) and fields[:, 5].sum() == 0

from __future__ import annotations

import re
from collections import Counter

from corpuslens.llm import quality

from .helpers import clash, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_base_statistics_on_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r["doc_id"]: brute(r["text"]) for r in df.collect()}
    got = {r["doc_id"]: tuple(r)[1:7] for r in quality.judge(df).collect()}
    assert got == want


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    texts = [None, "", "a b", "\x85 \xa0é", "a b c " * 30, "x y z\n" * 20 + " ".join(f"k{i}" for i in range(300)), long, long]
    df = clash(docs(spark, texts), "kept", "n_words", "rule")
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert {k: tuple(r)[1:7] for k, r in got.items()} == {i: brute(t) for i, t in enumerate(texts)}
    assert [got[i]["kept"] for i in range(len(texts))] == [False] * 6 + [True] * 2
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [6, 7]
    assert quality.judge(df.limit(0)).count() == 0


def test_order_never_changes_the_verdict(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = quality.judge(df, cascade=quality.Cascade(quality.RULES))
    b = quality.judge(df, cascade=quality.Cascade(quality.RULES[::-1]))
    assert a.exceptAll(b).count() == 0
    planned = quality.plan_cascade(df)
    assert {r.name for r in planned.rules} == {r.name for r in quality.RULES} and planned.seen
    worth = [planned.seen[r.name][1] / planned.seen[r.name][0] for r in planned.rules]
    assert worth == sorted(worth, reverse=True)


def test_junk_goes_and_clean_stays(spark):
    clean = " ".join(f"word{i % 97}a{i}" for i in range(400)) + ".\nAnother line."
    noisy = " ".join(f"word{i}###" for i in range(200))
    table = " | ".join(f"cell{i}" for i in range(200))
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs(spark, [clean, noisy, table, "THE%d" % 1 + " SHOUTED" * 3])).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False}


def test_order_counts_what_earlier_rules_leave():
    """A rule that rejects much, but nothing beyond a cheaper one, runs last."""
    rules = tuple(quality.Rule(x, lambda t: False) for x in "abc")
    got = quality.order(rules, {0b000: 50, 0b011: 40, 0b001: 5, 0b100: 5}, [1.0, 1.5, 1.0])
    assert [r.name for r in got.rules] == ["a", "c", "b"] and got.seen["a"] == (0.01, 0.45) and got.seen["b"][1] == 0
    assert quality.order(rules, {}, [0, 0, 0]).rules == rules

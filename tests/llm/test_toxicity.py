from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpuslens.llm import queries, toxicity

from .helpers import clash, docs


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "ti", "on", "re", "st", "ou"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 200))]
        bad = rng.random() < 0.15
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["grumb", "snork", "vequ" + word()])
        rows.append((i, " ".join(words)))
        if rng.random() < 0.5:
            labels.append((i, int(bad)))
    return rows, labels, None


def test_learns_words_and_beginnings_from_positives(spark):
    rows, labels, _ = corpus(1500, 1)
    df, told = docs(spark, rows), clash(spark.createDataFrame(labels, "doc_id long, toxic int"), "_key", "text")
    model = toxicity.train(df, told)
    fresh = [("calm " * 3 + "anon tire", 0), ("you snork anon ti", 1), ("vequzz stou an grumb", 1), ("", 0), (None, 0)]
    got = {r["doc_id"]: r for r in toxicity.score(clash(docs(spark, [t for t, _ in fresh]), "score", "predicted"), model).collect()}
    assert [got[i]["predicted"] for i in range(len(fresh))] == [y for _, y in fresh]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    long = toxicity.score(docs(spark, ["anon ti " * 100_000]), model).first()
    assert long["predicted"] == 0


def rows_of(lists):
    return toxicity.Rows([len(x) for x in lists], [c for x in lists for c, _ in x], [v for x in lists for _, v in x])


def test_risk_falls_and_stays_sane():
    rng = np.random.default_rng(0)
    row = lambda f: [(f, 1.0), (2 + int(rng.integers(5)), 1.0)]
    positive, unlabelled = [row(0) for _ in range(50)], [row(0) for _ in range(20)] + [row(1) for _ in range(180)]
    m = toxicity.Linear(7).fit(rows_of(positive), rows_of(unlabelled), 0.1)
    p = lambda f: float(m._sigmoid(np.array([m.scale * m.w[f] + m.b]))[0])
    assert p(0) > 0.9 > 0.1 > p(1) and m.risks[-1] < m.risks[0]
    # the last risk but one step, written out over single rows
    one = toxicity.Linear(7).fit(rows_of(positive), rows_of(unlabelled), 0.1, rounds=5)
    before = toxicity.Linear(7).fit(rows_of(positive), rows_of(unlabelled), 0.1, rounds=4)
    z = lambda x: before.b + sum(before.scale * before.w[c] * v for c, v in x)
    loss = lambda rows, sign: sum(math.log1p(math.exp(sign * z(x))) for x in rows) / len(rows)
    want = 0.1 * loss(positive, -1) + max(0, loss(unlabelled, 1) - 0.1 * loss(positive, 1))
    assert abs(one.risks[-1] - want) < 1e-4


def test_scores_equal_the_sums_over_features(spark):
    """A document's score is the mean of two logistic functions of its features' weights."""
    rows, labels, _ = corpus(600, 3)
    model = toxicity.train(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, rows[:40]), model).collect()}
    for k, t in rows[:40]:
        c = Counter(t.lower().translate(str.maketrans("", "", ".,;:!?")).split())
        value = {w: 1 + math.log(n) for w, n in c.items()}
        length, score = math.sqrt(sum(v * v for v in value.values())), 0.0
        for view, part, numbers in zip(toxicity.VIEWS, model.parts, model.numbers, strict=True):
            z = part.b + sum(part.scale * v / length * part.w[numbers[f]] for w, v in value.items() for f in toxicity.features(w.encode(), view) if f in numbers)
            score += 0.5 / (1 + math.exp(-z))
        assert abs(score - got[k]) < 1e-9


def test_draws_any_share(spark):
    """Shares of one in ten million and less are drawn, also of one key's rows; repeated labels and rows count once."""
    n = spark.range(200_000).select(F.lit(1).alias("_key"), F.col("id").alias("_text"))
    assert 60 < n.filter(toxicity.drawn(3, 0.0005, "_key", "_text")).count() < 140
    assert spark.range(1).filter(toxicity.drawn(1, 1.0, "id")).count() == 1 and spark.range(1000).filter(toxicity.drawn(1, 1e-11, "id")).count() == 0
    rows, labels, _ = corpus(600, 3)
    once = toxicity.train(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    twice = toxicity.train(docs(spark, rows), spark.createDataFrame([*labels, *labels, *((k, 0) for k, _ in labels)], "doc_id long, toxic int"))
    assert once.numbers == twice.numbers and once.prior == twice.prior


def test_query(spark, sf_dir):
    big = "/root/testdata/sf0.01"
    out = queries.op9_toxicity(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").collect()
    test = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in test} == {r["doc_id"] for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == r["toxic"] for r in test]) >= 0.9
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in out)


def test_no_labels_and_no_rows(spark):
    df = docs(spark, ["a b", None])
    none = spark.createDataFrame([(0, 0)], "doc_id long, toxic int")
    model = toxicity.train(df, none)
    assert [r["score"] for r in toxicity.score(df, model).collect()] == [0.0, 0.0]
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.train(df.limit(0), none.withColumn("toxic", F.lit(1))).parts == ()

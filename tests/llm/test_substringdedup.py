from __future__ import annotations

import hashlib
import random

import pytest

from corpuslens.llm import substringdedup

from .helpers import clash, docs


def brute(rows, window=50):
    """{(id, text): (n_words, n_removed, kept words)} of rows (id, text)."""
    first = {}
    for k, t in rows:
        words = (t or "").encode().split()
        for i in range(len(words) - window + 1 if k is not None else 0):
            w = tuple(words[i : i + window])
            first[w] = min(k, first.get(w, k))
    out = {}
    for k, t in rows:
        words = (t or "").encode().split()
        gone = {j for i in range(len(words) - window + 1 if k is not None else 0) if first[tuple(words[i : i + window])] < k for j in range(i, i + window)}
        out[k, t] = len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
    return out


def check(spark, rows, **options):
    df = docs(spark, rows)
    want = brute(rows)
    got = substringdedup.digests(df, **options).collect()
    by_id = {}
    for (k, _), v in want.items():
        by_id.setdefault(k, []).append((v[0], v[1], hashlib.sha256(v[2].encode()).hexdigest()))
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) in by_id[r["doc_id"]]
    assert len(got) == len(rows)
    cut = {r["doc_id"]: r["text"] for r in substringdedup.remove(df, **options).collect()}
    for (k, t), (_, n, kept) in want.items():
        if sum(k == x for x, _ in want) == 1:
            assert cut[k] == (kept if n else t)
    return want


def passages(seed, texts, window=50):
    """Texts that share passages at odd places, copies and near copies."""
    r = random.Random(seed)
    shared = [[f"s{p}.{i}" for i in range(n)] for p, n in enumerate((49, 50, 51, 80, 200, 700))]
    out = []
    for k in range(texts):
        words = []
        for _ in range(r.randrange(1, 4)):
            words += [f"w{r.randrange(30)}" for _ in range(r.randrange(0, 90))]
            p = r.choice(shared)
            a = r.randrange(max(1, len(p) - 60))
            words += p[a : a + r.randrange(20, 300)]
        out.append((k, (" " if k % 2 else "\n ").join(words)))
    return out + [(texts + k, t) for k, (_, t) in enumerate(out[:5])]


def test_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert any(n for _, n, _ in check(spark, rows).values())


@pytest.mark.parametrize("most", [1 << 16, 0])  # 0: every bucket of several strings is split window by window
def test_passages(spark, most):
    assert any(0 < n < size for size, n, _ in check(spark, passages(1, 60), most=most).values())


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(50))
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a b c"), (4, "a b c"), (5, long), (6, long), (7, long.rsplit(" ", 1)[0]), (8, f"{long} y"), (None, long), (9, "r " * 3000), (10, "r " * 70_000), (11, "r " * 49), (-1, f"é {long}")]
    want = check(spark, rows)
    assert want[6, long][1] == want[5, long][1] == 50 and want[8, f"{long} y"][2] == "y" and want[10, "r " * 70_000][1] == 70_000 and want[11, "r " * 49][1] == 0
    assert want[None, long][1] == 0
    check(spark, [(1, long), (1, long), (1, f"{long} z"), (2, f"q {long}"), (2, f"q {long}")])
    df = docs(spark, rows).limit(0)
    assert substringdedup.digests(df).count() == 0 and substringdedup.remove(df).count() == 0


def test_clashing_names(spark):
    long = " ".join(f"x{i}" for i in range(60))
    df = clash(docs(spark, [(1, long), (2, f"a {long} b")]), "_key", "_c1", "_spans", "_row", "_new", "_text", "_min")
    out = substringdedup.remove(df)
    assert out.columns == df.columns and {r["doc_id"]: r["text"] for r in out.collect()} == {1: long, 2: "a b"}


def test_one_passage_in_very_many_texts(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(k, f"{' '.join(f'a{k}.{i}' for i in range(40))} {passage} {' '.join(f'b{k}.{i}' for i in range(40))}") for k in range(400)]
    want = check(spark, rows, most=1000)
    assert [n for _, n, _ in want.values()] == [0] + [55] * 399


def test_minimisers():
    r = random.Random(2)
    words = [str(r.randrange(5)).encode() for _ in range(400)]
    found = substringdedup.minimisers(words, 50, 16)
    runs = {i: substringdedup.minimisers(words[i : i + 16], 16, 16)[0] for i in range(len(words) - 15)}
    assert found.view("u8").tolist() == [min(int(runs[j].view("u8")) for j in range(i, i + 35)) for i in range(351)]
    starts, sizes = substringdedup.super_kmers(found)
    assert sizes.sum() == 351 and all(len(set(found[a : a + n].tolist())) == 1 for a, n in zip(starts, sizes, strict=True))
    assert substringdedup.merged([0, 3, 60, 110, 200], 50) == [(0, 53), (60, 160), (200, 250)]

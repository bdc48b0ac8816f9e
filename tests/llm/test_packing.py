from __future__ import annotations

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuslens.llm import packing

from .helpers import clash, docs

TIK, HUG = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("tiktoken", "json"))
TEXTS = ["", None, "a", "two  spaces", " lead", "trail ", "a \n b", "x\0 y", "tab\t it", "it's we'll", "\xa0 　 z", "é ñ\n\n\nü", "<|endoftext|> no", "a <|endoftext|><|endoftext|>b", "日本 語", "a" * 3000, "w " * 5000]


@pytest.mark.parametrize("path", [TIK, HUG])
def test_ids_equal_the_tokenizer(path, spark, sf_dir):
    t = Tokenizer.from_file(HUG)
    rng = random.Random(5)
    odd = ["".join(rng.choice("ab  \n\t.\x85\xa0é'1") for _ in range(40)) for _ in range(400)]
    for x in [*TEXTS, *odd, *(r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect())]:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert packing.encoder(path).encode(x or "") == struct.pack(f"<{len(ids)}I", *ids)


def test_plan_holds_each_piece_once():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 500, 20_000):
        demand = np.bincount(rng.integers(1, 64, n), minlength=65)
        got = np.zeros(65, int)
        bins = 0
        for contents, times in packing.plan(demand, 64):
            assert sum(s * k for s, k in contents) <= 64 and times > 0
            bins += times
            for s, k in contents:
                got[s] += k * times
        assert (got == demand).all()
        assert bins <= 1.01 * (demand * np.arange(65)).sum() / 64 + 2


def test_cover_and_bound():
    """Weights cover all pieces, cost little more than the dual bound, and most sequences of a plan come from them."""
    rng = np.random.default_rng(9)
    for demand, loose in ((np.bincount(rng.integers(1, 200, 3000), minlength=201), 1.03), (np.bincount([140] * 50 + [110] * 30 + [60] * 20, minlength=201), 1.0001), (np.bincount([101] * 7, minlength=201), 1.0001)):
        weights, bound = packing.configurations(demand, 200)
        covered = np.zeros(201)
        for c, w in weights:
            assert sum(s * n for s, n in c) <= 200
            for s, n in c:
                covered[s] += n * w
        total = sum(w for _, w in weights)
        assert np.allclose(covered, demand) and bound - 1e-6 <= total <= loose * max(bound, demand[101:].sum())
        used = sum(n for _, n in packing.plan(demand, 200))
        assert used >= bound - 1e-6 and used <= loose * max(bound, demand[101:].sum()) + 3
    demand = np.bincount(rng.integers(1, 200, 3000), minlength=201)
    alone = []
    before, packing._best_fit = packing._best_fit, lambda left, capacity: (alone.append(left), before(left, capacity))[1]
    try:
        packing.plan(demand, 200)
    finally:
        packing._best_fit = before
    assert sum(s * n for s, n in alone[0].items()) < 0.2 * (demand * np.arange(201)).sum()


def test_pack(spark, sf_dir):
    df = clash(spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(docs(spark, [(10_000 + i, x) for i, x in enumerate(TEXTS)])), "length", "piece", "_rank")
    t = Tokenizer.from_file(HUG)
    ids = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in df.collect()}
    rows = packing.pack(df, TIK).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert by_doc.keys() == ids.keys()
    for k, rs in by_doc.items():
        rs.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in rs] == list(range(len(rs))) and len(rs) == -(-len(ids[k]) // 1024)
        at = 0
        for r in rs:
            part = ids[k][at : at + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            assert r["piece"] == 0 or r["length"] == 1024
            at += r["length"]
        assert at == len(ids[k])
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(by_seq) <= 1.02 * sum(map(len, ids.values())) / 1024 + 1


def test_repeated_rows_and_empty_table(spark):
    df = docs(spark, [(1, "a b"), (1, "a b"), (1, "a b")])
    rows = packing.pack(df, TIK).collect()
    assert len(rows) == 3 and sorted(r["offset"] for r in rows) == [0, 3, 6] and len({r["sequence_id"] for r in rows}) == 1
    assert packing.pack(df.limit(0), TIK).count() == 0

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from corpuslens.llm import prefixtrie, queries

from .helpers import clash

CHAT = "conv_id long, turn long, role string, text string"


def own_turns(rows):
    out = defaultdict(list)
    for c, n, r, t in rows:
        if c is not None:
            r, t = r or "", t or ""
            out[c].append(((n is not None, n or 0), r, hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest(), t))
    return {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in out.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode().split()) if k else 0)
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k)))).encode()).hexdigest())
        for k, m in members.items()
    )


def plain(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


@pytest.mark.parametrize(("shards", "deepest", "waiting"), [(1, 64, 50_000), (7, 64, 50_000), (40, 1, 0), (40, 64, 3)])
def test_shards(spark, shards, deepest, waiting):
    r = random.Random(shards)
    rows = [(c, n, "user" if n % 2 else "assistant", " ".join(["a", "b b", "c"][r.randrange(3)] for _ in range(r.randrange(2)))) for c in range(-30, 300) for n in range(r.randrange(1, 7))]
    rows += [(c, n, "user", "hello there") for c in range(1000, 1200) for n in range(3)] + [(2000, n, "user", "deep") for n in range(500)] + [(c, 0, "user", f"wide {c}") for c in range(3000, 3200)]
    own = own_turns(rows)
    told = prefixtrie.turns(spark.createDataFrame(rows, CHAT).repartition(5))
    assert plain(prefixtrie.trie(told, shards=shards, deepest=deepest, waiting=waiting)) == brute(own)
    assert plain(prefixtrie.trie(prefixtrie.with_shared_beginnings(told), shards=shards, deepest=deepest, waiting=waiting)) == brute(rebuilt(own))


def test_edges(spark):
    rows = [
        (20, None, None, None), (20, 2, "user", "x  y\n\vz"), (20, 2, "user", "x  y\n\vz"), (20, 1, None, "é"), (21, 0, "user", ""), (21, 0, "user", None), (22, 5, "user", "q" * 300_000), (None, 1, "user", "lost"),
        (23, 1, "a\nb", "c"), (24, 1, "a", "b\nc"), (0, 1, "user", "w"), (1, 1, "user", "w"), (-7, 1, "user", "w"), (65, 1, "user", "w"),
    ]
    df = clash(spark.createDataFrame(rows, CHAT), "_t", "_h", "_base", "turns", "key", "path", "n_convs")
    told = prefixtrie.turns(df)
    assert plain(prefixtrie.trie(told, shards=5)) == brute(own_turns(rows))
    got = prefixtrie.trie(prefixtrie.with_shared_beginnings(told), shards=5)
    assert plain(got) == brute(rebuilt(own_turns(rows))) and got.columns == [c.split()[0] for c in prefixtrie._RESULT.split(", ")]
    assert prefixtrie.trie(prefixtrie.with_shared_beginnings(prefixtrie.turns(df.limit(0)))).count() == 0


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = plain(queries.op13_prefix_trie(spark, sf_dir))
    assert got == brute(rebuilt(own_turns(rows)))
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    assert sorted(tuple(-1 if v is None else v for v in x) for x in c.sql(queries.OP13_SQL).fetchall()) == got

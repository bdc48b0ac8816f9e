from __future__ import annotations

import itertools
import random
import re

import numpy as np
import xxhash

from corpuslens.llm import simhash

from .helpers import Union, clash, docs


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps):
    u = Union()
    for (a, x), (b, y) in itertools.combinations(sorted(fps.items()), 2):
        if (x ^ y).bit_count() <= 2:
            u.join(a, b)
    return {k: u.find(k) for k in fps}


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(docs(spark, [(1000, None), (1001, ""), (1002, "One"), (1003, "one"), (1004, "É two"), (1005, "a B c"), (1006, "x " * 40_000)]))
    fps = {r["doc_id"]: brute(r["text"]) for r in df.collect()}
    want = {k: (f"{fps[k]:016x}", c) for k, c in groups(fps).items()}
    got = simhash.near_duplicates(clash(df, "fp", "part", "bits", "component_id"))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got.collect()} == want
    kept = simhash.keep_one(clash(df, "fp", "_others"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(near_groups({r["doc_id"]: r["text"] for r in df.collect()}).values()))


def test_links_at_each_level(spark):
    """A dense cloud of fingerprints, with postings cut at 256, at 4 and at 2 rows."""
    rng = random.Random(1)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(60)}
    fps |= {rng.getrandbits(64) for _ in range(50)} | {centres[0] ^ x for x in range(40)}
    nodes = {signed(x): x for x in fps}
    want = groups(nodes)
    df = spark.createDataFrame([(k,) for k in nodes], "fp long")
    for most in (256, 4, 2):
        u = Union()
        for r in simhash.links(df, most).collect():
            u.join(r["x"], r["y"])
        assert {k: u.find(k) for k in nodes} == want


def test_ties_and_empty_table(spark):
    df = docs(spark, [(5, "same words here now"), (5, "same words here now"), (3, "same words here now"), (9, None)])
    assert sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()) == [(3, 3), (5, 3), (5, 3), (9, 9)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.keep_one(df.limit(0)).count() == 0


def shingles(text, width=5):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def near_groups(texts, least=0.8):
    """{key: smallest key of its group}, with every pair of distinct sets compared."""
    sets, first, u = {k: shingles(t) for k, t in texts.items()}, {}, Union()
    for k in sorted(sets):
        u.find(k)
        if sets[k] in first:
            u.join(first[sets[k]], k)
        first.setdefault(sets[k], k)
    reps = sorted(((len(s), k, s) for s, k in first.items() if s), key=lambda x: x[:2])
    for i, (n, a, x) in enumerate(reps):
        for m, b, y in reps[i + 1 :]:
            if m * least > n:
                break
            both = len(x & y)
            if both >= least * (n + m - both):
                u.join(a, b)
    return {k: u.find(k) for k in texts}


def edited(rng, words, share):
    return [rng.choice("xylo quartz plinth ember".split()) + str(rng.randrange(999)) if rng.random() < share else w for w in words]


def test_near_copies_equal_all_pairs(spark):
    """Copies with up to one word in 20 edited, of 10 to 3000 words, behind a passage that all share."""
    rng = random.Random(8)
    passage, texts = [f"p{i}" for i in range(60)], {}
    for n in (10, 25, 60, 150, 400, 1000, 3000):
        for _ in range(6):
            own = (passage if n > 100 else []) + [f"w{rng.randrange(5000)}" for _ in range(n)]
            for share in (0, 0, 0.01, 0.02, 0.03, 0.05):
                texts[len(texts)] = " ".join(edited(rng, own, share)).upper()
    texts |= {1000: None, 1001: "", 1002: "one two", 1003: "One  two", 1004: "one two three"}
    prints, found = simhash.similar(docs(spark, list(texts.items())), most=8)
    component = {bytes(r["node"]): bytes(r["component"]) for r in found.collect()}
    got, want = {r["doc_id"]: component.get(bytes(r["cls"]), bytes(r["cls"])) for r in prints.collect()}, near_groups(texts)
    assert len(set(want.values())) < 0.7 * len(want)
    pairs = lambda ids: {frozenset(k for k in ids if ids[k] == g) for g in ids.values()}
    assert pairs(got) == pairs(want)


def test_keep_one_of_repeated_and_missing_keys(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(1, long), (1, long), (1, long.upper()), (1, "other text of one key"), (2, long + " end"), (None, long), (None, "no key"), (None, "no key"), (3, "other text of one key"), (4, None), (5, "")]
    df = clash(docs(spark, rows), "_row", "_k", "cls", "component", "_other")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(df).collect()), key=str)
    assert got == sorted([(False, 1, long.upper()), (False, 1, "other text of one key"), (True, 0, "no key"), (False, 4, None)], key=str)
    assert simhash.keep_one(df.limit(0)).count() == 0 and simhash.keep_one(df).columns == df.columns


def test_marks_meet_at_the_similarity():
    """At 0.8, too few of 24 marks are shared in less than one of 500 pairs."""
    rng = np.random.default_rng(1)
    lost = 0
    for n in (30, 100, 300, 2000):
        c = max(1, round(n / 9))
        for _ in range(250):
            x = rng.integers(0, 1 << 64, n + c, dtype=np.uint64)
            a, b = (dict(simhash.marks(np.sort(s))) for s in (x[:n], x[c:]))
            need = lambda v: 3 if v >= 5 else 2 if v == 4 else 1
            lost += not any(len(set(a[v]) & set(b[v])) >= need(v) for v in a.keys() & b.keys())
    assert lost <= 2


def test_short_sets_meet_at_the_similarity():
    """Sets of four against five shingles and the like share a mark whenever they share a shingle."""
    rng = np.random.default_rng(2)
    for n in (4, 5, 8, 9):
        for _ in range(200):
            x = rng.integers(0, 1 << 64, n + 1, dtype=np.uint64)
            a, b = (dict(simhash.marks(np.sort(s))) for s in (x[:n], x))
            assert any(set(a[v]) & set(b[v]) for v in a.keys() & b.keys())


def test_positional_bytes_tell_the_similarity():
    rng = np.random.default_rng(3)
    low, enough = 0, simhash.least_bytes(0.8)
    for n in (9, 90, 5000):
        for _ in range(100):
            x = rng.integers(0, 1 << 64, n + n // 3, dtype=np.uint64)
            c, d = (np.frombuffer(simhash.signature(s), np.uint8) for s in (x[:n], x[n // 9 : n + n // 9]))
            low += (c == d).sum() < enough  # at 8 of 10
    assert low == 0


def test_a_passage_that_very_many_share(spark):
    """Hundreds of long texts with most words in common, none a near copy but for the planted ones, in one posting."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(300)]
    texts = {k: " ".join([*passage, *(f"w{k}.{i}" for i in range(120))]) for k in range(300)}
    texts |= {1000 + k: texts[k].replace(f"w{k}.{rng.randrange(120)}", "changed") for k in range(0, 300, 30)}
    kept = {r["doc_id"] for r in simhash.keep_one(docs(spark, list(texts.items())), most=64).collect()}
    assert kept == set(range(300))

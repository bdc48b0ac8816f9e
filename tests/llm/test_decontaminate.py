from __future__ import annotations

import random

import numpy as np

from corpuslens.llm import decontaminate as dc

from .helpers import clash, docs


def brute_align(a, b):
    best, h = 0.0, [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1][j] - 0.5, h[i][j - 1] - 0.5)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_full_matrix():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        score, i, j = dc.align(np.array(a), np.array(b))
        assert score == brute_align(a, b)
        assert brute_align(a, b[i:j]) == score


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards brew potions near an old stone bridge at dawn"


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < share / 3 else [w, "extra"] if x < 2 * share / 3 else ["changed"] if x < share else [w]
    return out


def test_copies_found_and_clean_left(spark):
    rng = random.Random(4)
    noise = lambda n: [rng.choice("alpha beta gamma delta the over an at near old".split()) for _ in range(n)]
    texts = [None, "", " ".join(noise(400)), " ".join([*noise(50), *ITEM.split(), *noise(50)]), ITEM.upper() + "!!", " ".join([*noise(20_000), *ITEM.split()])]
    texts += [" ".join([*noise(80), *edited(rng, ITEM.split(), 0.2), *noise(80)]) for _ in range(20)]
    texts += [" ".join(ITEM.split()[:5] + noise(300))]
    bench = clash(spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "zyx wvu"), (1, ITEM)], "item_id long, text string"), "doc_id")
    df = clash(docs(spark, texts), "score", "item_id", "_bad")
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(df, bench).collect()}
    assert got == {(i, 1) for i in range(3, 26)}
    in_blocks = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(df, bench, block_items=1).collect()}
    assert in_blocks == got
    kept = dc.drop_contaminated(docs(spark, texts), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 26]
    assert dc.contaminated(df.limit(0), bench).count() == 0 and dc.contaminated(df, bench.limit(0)).count() == 0


def test_whole_table_against_all_pairs(spark, sf_dir):
    """Every item is aligned with every text: seeds lose no pair that scores."""
    df, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]): round(r["score"], 6) for r in dc.contaminated(df, bench).collect()}
    items = [(r["item_id"], dc.tokens(r["text"])) for r in bench.collect()]
    want = {}
    for r in df.filter("length(text) < 6000").collect():
        known: dict = {}
        for k, item in items:
            for w in item:
                known.setdefault(w, len(known))
        words = dc.numbers(r["text"], known)
        for k, item in items:
            score = dc.align(np.array([known[w] for w in item]), words)[0] / len(item)
            if score >= dc.LEAST_SCORE:
                want[r["doc_id"], k] = round(score, 6)
    assert want and want.items() <= got.items()


def test_edited_items_keep_seeds_at_any_size(spark):
    """Items of frequent words with up to one word in six edited are found, however often their words occur elsewhere."""
    rng = random.Random(6)
    common = [f"c{i}" for i in range(40)]
    items = {i: [rng.choice(common) for _ in range(40)] for i in range(30)}
    texts = {}
    for i, words in items.items():
        for k in range(4):
            at = sorted(rng.sample(range(40), 6)) if k else []
            copy = [f"x{k}" if j in at else w for j, w in enumerate(words)]
            texts[i * 10 + k] = " ".join([rng.choice(common) for _ in range(60)] + copy + [rng.choice(common) for _ in range(60)])
    filler = [(10_000 + j, " ".join(rng.choice(common) for _ in range(2000))) for j in range(60)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in dc.contaminated(docs(spark, [*texts.items(), *filler]), bench).collect()}
    missed = [(k, k // 10) for k in texts if (k, k // 10) not in got and brute_align(items[k // 10], texts[k].split()) >= dc.LEAST_SCORE * 40]
    assert len(missed) <= 1 and not any(d >= 10_000 for d, _ in got)


def test_words_put_in_between(spark):
    """Items in which no three words stay together: a word after every second or after each word, every third word changed or left out."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    items = {i: [rng.choice(vocabulary) for _ in range(rng.randrange(12, 60))] for i in range(40)}
    ways = [
        lambda j, w: [w, rng.choice(vocabulary)] if j % 2 else [w],
        lambda j, w: [w, rng.choice(vocabulary)],
        lambda j, w: [rng.choice(vocabulary)] if j % 3 == 2 else [w],
        lambda j, w: [] if j % 3 == 2 else [w],
    ]
    noise = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = {i * 10 + k: noise(150) + [x for j, w in enumerate(words) for x in way(j, w)] + noise(150) for i, words in items.items() for k, way in enumerate(ways)}
    clean = [(10_000 + j, " ".join(noise(3000))) for j in range(30)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    rows = dc.contaminated(docs(spark, [*((k, " ".join(t)) for k, t in texts.items()), *clean]), bench).collect()
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in rows}
    scores = {k: brute_align(items[k // 10], t) / len(items[k // 10]) for k, t in texts.items()}
    want = {(k, k // 10) for k, score in scores.items() if score >= dc.LEAST_SCORE}
    assert len(want) > 100 and {k % 10 for k, _ in want} == {0, 1, 2, 3}
    assert not want - set(got) and all(abs(got[k] - scores[k[0]]) < 1e-9 for k in want)
    assert not any(d >= 10_000 for d, _ in got)


def test_short_items_keep_whole_seeds(spark):
    """Two words of an item of four or five are no copy."""
    bench = spark.createDataFrame([(1, "red stone old bridge"), (2, "seven wizards brew potions well")], "item_id long, text string")
    got = dc.contaminated(docs(spark, ["a red stone lies there", "the old bridge", "seven wizards", "red stone old bridge", "so wizards brew potions"]), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(3, 1), (4, 2)}

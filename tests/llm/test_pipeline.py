from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers

import corpus_pipeline
from corpuslens.llm import decontaminate, quality
from corpuslens.llm.packing import encoder

from .helpers import clash, docs
from .test_linededup import brute as brute_lines
from .test_simhash import near_groups


def brute(texts: dict, bench: dict) -> list[dict]:
    """What each stage but the last keeps: {doc_id: text}."""
    out = []
    kept = {k: t for k, t in texts.items() if not quality.base_failed(len((x := quality.Text(t)).words), quality.repeat_words(x)) and not any(r.rejects(x) for r in quality.RULES)}
    out.append(kept)
    cut = brute_lines(kept)
    kept = {k: t for k, (t, n) in cut.items() if not n or t.strip(" \t\n\v\f\r")}
    out.append(kept)
    ids = near_groups(kept)
    kept = {k: t for k, t in kept.items() if ids[k] == k}
    out.append(kept)
    items = [decontaminate.tokens(t) for t in bench.values()]
    known = {w: i for i, w in enumerate(dict.fromkeys(w for t in items for w in t))}
    arrays = [np.array([known[w] for w in t]) for t in items]

    def may(a: np.ndarray, w: np.ndarray) -> bool:
        """m matches with at most 2m - n edits lie within 2n words of the text, so half of the item's n words are there; else no matrix is needed."""
        sums = np.concatenate([[0], np.cumsum(np.isin(w, a))])
        return len(w) > 0 and int((sums[np.minimum(np.arange(len(w)) + 2 * len(a), len(w))] - sums[:-1]).max()) * 2 >= len(a)

    def bad(text: str) -> bool:
        w = decontaminate.numbers(text, known)
        return any(may(a, w) and decontaminate.align(a, w)[0] >= decontaminate.LEAST_SCORE * len(a) for a in arrays)

    out.append({k: t for k, t in kept.items() if not bad(t)})
    return out


def test_each_stage_on_its_input(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute({r["doc_id"]: r["text"] for r in df.collect()}, {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()})
    now = df
    for (name, stage), kept in zip(corpus_pipeline.STAGES, want, strict=False):
        now = stage(spark, now, sf_dir).cache()
        assert now.columns == df.columns, name
        rows = now.collect()
        assert {r["doc_id"]: r["text"] for r in rows} == kept, name
        assert all(r["n_chars"] == len(r["text"]) for r in rows if r["doc_id"] in kept) and len(rows) == len(kept)
    lengths = {k: len(encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).ids(t)) + 1 for k, t in want[-1].items()}
    held, by_seq = defaultdict(int), defaultdict(int)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        held[r["doc_id"]] += r["length"]
        by_seq[r["sequence_id"]] += r["length"]
    assert held == lengths and max(by_seq.values()) <= 1024


def test_odd_rows(spark, sf_dir):
    texts = [None, "", " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i % 977}x{i}" for i in range(60_000))]
    now = clash(docs(spark, texts), "_bad", "_gone_key", "fp", "sequence_id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
    assert sorted(r["doc_id"] for r in now.collect()) == [2, 4]
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {2, 4}
    empty = now.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    assert zlib.crc32(b"") == 0

from __future__ import annotations

import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslens.llm import queries, tokencount
from corpuslens.llm.packing import encoder

from .helpers import clash, docs

TIK = public_tokenizers.path("byte_bpe_50k.tiktoken")
n_tokens = lambda t: len(encoder(TIK).ids(t or ""))


def brute(text, edits):
    out, last = [], 0
    for a, b, new in sorted(edits):
        if last <= a <= b <= len(text):
            out += [text[last:a], new]
            last = b
    return "".join([*out, text[last:]])


def counted(text, span):
    s = tokencount.cut(text, span)
    encode = encoder(TIK).encode
    return tokencount.Counted(text, s, tokencount.sums([len(encode(text[a:b])) // 4 for a, b in zip(s, [*s[1:], len(text)], strict=False)]), encode, span)


@settings(max_examples=400, deadline=None)
@given(st.text("ab .\n1é ", max_size=120), st.lists(st.tuples(st.integers(0, 130), st.integers(0, 8), st.text("ab .\n", max_size=6)), max_size=6), st.integers(1, 20))
def test_edits_equal_a_full_count(text, edits, span):
    edits = [(a, a + n, new) for a, n, new in edits]
    c = counted(text, span)
    assert c.total == n_tokens(text)
    for _ in range(2):  # a second round of edits works on the first one's tree
        want = brute(c.text, edits)
        c.edit(edits)
        assert (c.text, c.total) == (want, n_tokens(want))
        assert c.tree == tokencount.sums([c.leaf(i) for i in range(len(c.starts))])


def test_small_edit_of_a_long_text_encodes_little():
    rng = random.Random(0)
    text = " ".join("".join(rng.choice("abcde") for _ in range(6)) for _ in range(50_000))
    c = counted(text, 2000)
    assert c.edit([(170_000, 170_006, "zzz")]) == 1
    assert c.encoded < 5000 and c.total == n_tokens(c.text)


def test_frames(spark):
    texts = [None, "", "one two three", " \n ", "x " * 5000]
    edits = spark.createDataFrame([(0, 0, 0, "new"), (1, 0, 0, "a b"), (2, 4, 7, "2"), (2, 5, 6, "overlaps"), (4, 9990, 10_000, None), (77, 0, 1, "none")], "doc_id long, start int, stop int, new string")
    df = clash(docs(spark, texts), "n_tokens", "tree", "_edited")
    got = {r["doc_id"]: r for r in tokencount.recount(tokencount.count(tokencount.with_edits(clash(docs(spark, texts), "_edited", "edits"), edits), TIK, further=("edits",)), TIK).collect()}
    assert {k: r["text"] for k, r in got.items()} == {0: "new", 1: "a b", 2: "one 2 three", 3: " \n ", 4: "x " * 4995}
    assert all(r["n_tokens"] == n_tokens(r["text"]) for r in got.values()) and [got[i]["n_edits"] for i in range(5)] == [1, 1, 1, 0, 1]
    assert {r["doc_id"]: r["n_tokens"] for r in tokencount.count(df, TIK).collect()} == {i: n_tokens(t) for i, t in enumerate(texts)}
    assert tokencount.count(df.limit(0), TIK).count() == 0


def test_query(spark, sf_dir):
    import re

    rows = {r["doc_id"]: r for r in queries.op7_token_counts(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        got, after = rows[r["doc_id"]], re.sub(queries.MASKED, queries.MASK, r["text"])
        assert (got["n_tokens"], got["n_tokens_edited"]) == (n_tokens(r["text"]), n_tokens(after))
    assert sum(r["n_edits"] for r in rows.values()) > 0

from __future__ import annotations

from collections import defaultdict

from corpuslens.llm import linededup

from .helpers import clash, docs


def brute(rows, width=3):
    first, out = {}, {}
    for pas in (0, 1):
        for k, t in sorted(rows.items()):
            lines = t.split("\n") if t is not None else []
            gone = set()
            for i in range(len(lines) - width + 1):
                run = tuple(lines[i : i + width])
                if "".join(run).strip(" \t\n\v\f\r"):
                    if first.setdefault(run, (k, i)) != (k, i) and pas:
                        gone |= set(range(i, i + width))
            out[k] = ("\n".join(x for i, x in enumerate(lines) if i not in gone) if t is not None else None, len(gone))
    return out


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute({r["doc_id"]: r["text"] for r in df.collect()})
    assert any(n for _, n in want.values())
    assert {r["doc_id"]: (r["text"], r["_n_gone"]) for r in linededup.dedup(df).collect()} == want


def test_edges(spark):
    texts = [None, "", "a\nb", "a\nb\nc\nd", "x\na\nb\nc\nd\ny", "a\nb\nc\na\nb\nc\nz", "\n\n\n\n", "\n\n\n\n", "q\n" * 3000 + "r", "k\na\nb\nc"]
    df = clash(docs(spark, texts), "_key", "_at", "_gone", "_h", "_row", "_id", "_text", "_n_gone")
    got = {r["doc_id"]: (r["text"], r["_n_gone"]) for r in linededup.dedup(df).collect()}
    assert got == brute(dict(enumerate(texts)))
    assert got[4] == ("x\ny", 4) and got[9] == ("k", 3)
    kept = linededup.drop_repeats(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    twins = linededup.drop_repeats(docs(spark, ["a\nb\nc", "a\nb\nc"])).collect()
    assert [r["doc_id"] for r in twins] == [0]
    assert linededup.dedup(df.limit(0)).count() == 0
    same = linededup.dedup(docs(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc")])).collect()
    assert [r["text"] for r in same] == ["a\nb\nc"] * 3

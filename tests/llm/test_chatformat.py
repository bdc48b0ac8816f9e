from __future__ import annotations

import hashlib

from corpuslens.llm import chatformat, queries

from .helpers import clash

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    chats = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        chats.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return chats


def test_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "", None, "### user: x</turn>\n", "\\", "\\\\#", "#:<\\" * 30_000, "é日本\n\n", "a" * 300_000]
    rows = [(i, 0, "user", t) for i, t in enumerate(odd)] + [(i, 1, "assistant", t) for i, t in enumerate(odd)]
    rows += [(50, 0, "user", "a"), (50, 0, "user", "a"), (51, 0, "we#ird: role", "x"), (52, None, None, None), (None, 1, "assistant", "z"), (53, 0, "system", "s"), (53, 1, "user", "u"), (53, 2, "assistant", "v")]
    df = clash(spark.createDataFrame(rows, SCHEMA), "_t", "segments", "formatted")
    out = chatformat.read_back(chatformat.format_chats(df)).collect()
    want = brute(rows)
    assert {r["conv_id"] for r in out} == want.keys()
    for r in out:
        assert [tuple(x) for x in r["turns"]] == want[r["conv_id"]]
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
        assert r["loss_text"] == "".join(t for role, t in want[r["conv_id"]] if role == "assistant")
    assert {r["conv_id"]: r["valid"] for r in out} == {**dict.fromkeys(range(len(odd)), True), 50: False, 51: False, 52: False, None: False, 53: True}
    assert chatformat.format_chats(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    told = "\\### Assistant: </turn> ok"
    want = brute([*rows, (-7, 0, "user", told), (-7, 1, "assistant", told)])
    for r in queries.op4_chat_format(spark, sf_dir).collect():
        turns = want.pop(r["conv_id"])
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert not want


def test_segments_carry_the_machine_s_states(spark):
    rows = [(1, i, r, r) for i, r in enumerate(["system", "user", "assistant", "user", "assistant"])] + [(2, i, r, r) for i, r in enumerate(["user", "user", "assistant"])] + [(3, 0, "user", "x")]
    got = {r["conv_id"]: r for r in chatformat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    states = lambda k: [s["state"] for s in got[k]["segments"]][::3]
    assert states(1) == ["opened", "asked", "answered", "asked", "answered"] and states(2) == ["asked", "refused", "refused"] and states(3) == ["asked"]
    assert [got[k]["valid"] for k in (1, 2, 3)] == [True, False, False]
    assert all([s["loss"] for s in got[k]["segments"]] == [x for r in got[k]["segments"][1::3] for x in (False, r["text"] == "assistant", False)] for k in (1, 2, 3))

"""Edit-aware token counts.

A document keeps a tree over segments of about `span` characters, cut where the pre-tokenizer cuts anyway, so token counts of segments add
up. An edit changes characters in some segments; only these are encoded again, with neighbours as long as an edge of the changed
stretch is no longer a place where the pre-tokenizer is sure to cut. Then the sums above the changed leaves are updated.

Edits name places in the text before any of them; they are taken by start, and an edit that overlaps one before it, or lies outside
the text, isn't applied. Null texts count as empty: no segments, no tokens. Repeated rows are counted each for itself. Texts are read
whole. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns
from .packing import encoder

_SAFE = re.compile(r"(?<=\S)(?= \S)")
EDITS = "array<struct<start:int,stop:int,new:string>>"


def cut(text: str, span: int) -> list[int]:
    """Starts of segments."""
    starts, at = [0] if text else [], span
    while at < len(text) and (m := _SAFE.search(text, at)):
        starts.append(m.start())
        at = m.start() + span
    return starts


def sums(leaves: list[int]) -> list[int]:
    """A binary tree in one list: node i has the children 2i and 2i + 1, node 1 is the root, the leaves are the second half."""
    size = 1
    while size < len(leaves):
        size *= 2
    tree = [0] * size + leaves + [0] * (size - len(leaves))
    for i in range(size - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


def put(tree: list[int], leaf: int, count: int) -> None:
    """Sets a leaf and updates the sums above it."""
    i = len(tree) // 2 + leaf
    change = count - tree[i]
    while i:
        tree[i] += change
        i //= 2


class Counted:
    """A text with its segments and their tree."""

    def __init__(self, text: str, starts: list[int], tree: list[int], encode, span: int):
        self.text, self.starts, self.tree, self.encode, self.span, self.encoded = text, list(starts), list(tree), encode, span, 0

    def leaf(self, i: int) -> int:
        return self.tree[len(self.tree) // 2 + i]

    @property
    def total(self) -> int:
        return self.tree[1] if len(self.tree) > 1 else 0

    def edit(self, edits: list[tuple[int, int, str]]) -> int:
        """Applies edits; gives back how many."""
        text, starts, n = self.text, self.starts, len(self.starts)
        good, last = [], 0
        for a, b, new in sorted(edits):
            if last <= a <= b <= len(text):
                good.append((a, b, new))
                last = b
        if not good:
            return 0
        ends = [*starts[1:], len(text)] if n else []
        groups: list[list] = []  # [first segment, last segment, edits]
        at = 0
        for e in good:
            while at + 1 < n and ends[at] <= e[0] and starts[at + 1] <= e[0]:
                at += 1
            to = at
            while to + 1 < n and starts[to + 1] < e[1]:
                to += 1
            if groups and at <= groups[-1][1]:
                groups[-1][1] = max(groups[-1][1], to)
                groups[-1][2].append(e)
            else:
                groups.append([at, to, [e]])

        def changed(lo: int, hi: int, es: list) -> str:
            at, parts = (starts[lo] if n else 0), []
            for a, b, new in es:
                parts += [text[at:a], new]
                at = b
            return "".join([*parts, text[at : ends[hi]] if n else ""])

        done: list[list] = []
        while groups:
            lo, hi, es = groups.pop(0)
            new = changed(lo, hi, es)
            if lo > 0 and (not re.match(r" \S", new) or (done and done[-1][1] == lo - 1 and not re.search(r"\S\Z", done[-1][3]))):
                lo -= 1
                if done and done[-1][1] >= lo:
                    before = done.pop()
                    lo, es = before[0], before[2] + es
                groups.insert(0, [lo, hi, es])
            elif hi + 1 < n and not re.search(r"\S\Z", new):
                hi += 1
                if groups and groups[0][0] <= hi:
                    after = groups.pop(0)
                    hi, es = max(hi, after[1]), es + after[2]
                groups.insert(0, [lo, hi, es])
            else:
                done.append([lo, hi, es, new])
        out_text, out_starts, leaves, at, same = [], [], [], 0, True
        here, fresh = 0, []
        for lo, hi, _, new in [*done, [n, n - 1, [], ""]]:
            for i in range(at, min(lo, n)):
                out_starts.append(here)
                leaves.append(self.leaf(i))
                out_text.append(text[starts[i] : ends[i]])
                here += ends[i] - starts[i]
            parts = cut(new, self.span)
            for a, b in zip(parts, [*parts[1:], len(new)], strict=False):
                fresh.append((len(leaves), len(self.encode(new[a:b])) // 4))
                out_starts.append(here)
                leaves.append(fresh[-1][1])
                out_text.append(new[a:b])
                here += b - a
            self.encoded += len(new)
            same &= len(parts) == hi + 1 - lo
            at = hi + 1
        if same and len(leaves) == n:
            for i, count in fresh:
                put(self.tree, i, count)
        else:
            self.tree = sums(leaves)
        self.text, self.starts = "".join(out_text), out_starts
        return len(good)


def count(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", span: int = 2000, further: tuple[str, ...] = ()) -> DataFrame:
    """key, text, n_tokens, starts and tree, and the columns `further`, for each row of df."""

    def rows(keys: list, texts: list, *others: list) -> dict[str, list]:
        encode = encoder(vocabulary).encode
        starts = [cut(t or "", span) for t in texts]
        trees = [sums([len(encode(t[a:b])) // 4 for a, b in zip(s, [*s[1:], len(t or "")], strict=False)]) for t, s in zip(texts, starts, strict=True)]
        return {key: keys, text: texts, "n_tokens": [t[1] if len(t) > 1 else 0 for t in trees], "starts": starts, "tree": trees} | dict(zip(further, others, strict=True))

    kinds = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in further)
    return map_columns(df, [key, text, *further], f"`{key}` {df.schema[key].dataType.simpleString()}, `{text}` string, n_tokens long, starts array<int>, tree array<int>{kinds}", rows)


def recount(counted: DataFrame, vocabulary: str, edits: str = "edits", key: str = "doc_id", text: str = "text", span: int = 2000) -> DataFrame:
    """counted, with a column of edits, after these edits: key, text, n_tokens, starts, tree, n_edits, n_chars_encoded, n_tokens_before."""
    names = (key, text, "n_tokens", "starts", "tree", "n_edits", "n_chars_encoded", "n_tokens_before")

    def rows(keys: list, texts: list, before: list, starts: list, trees: list, changes: list) -> dict[str, list]:
        encode = encoder(vocabulary).encode
        out: dict[str, list] = {k: [] for k in names}
        for k, t, n, s, tree, es in zip(keys, texts, before, starts, trees, changes, strict=True):
            c = Counted(t or "", s, tree, encode, span)
            done = c.edit([(e["start"], e["stop"], e["new"] or "") for e in es or ()])
            for name, v in zip(names, (k, c.text if done else t, c.total, c.starts, c.tree, done, c.encoded, n), strict=True):
                out[name].append(v)
        return out

    kind = counted.schema[key].dataType.simpleString()
    return map_columns(
        counted, [key, text, "n_tokens", "starts", "tree", edits], f"`{key}` {kind}, `{text}` string, n_tokens long, starts array<int>, tree array<int>, n_edits long, n_chars_encoded long, n_tokens_before long", rows
    )


def with_edits(df: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """df with the column edits: the rows of `edits` (key, start, stop, new) of each document."""
    lists = edits.groupBy(F.col(key).alias("_edited")).agg(F.collect_list(F.struct(F.col("start").cast("int"), F.col("stop").cast("int"), F.col("new").cast("string"))).cast(EDITS).alias("edits"))
    return df.join(lists, df[key] == lists["_edited"], "left").select(*(df[c] for c in df.columns if c != "edits"), lists["edits"])


def masks(text: Column, pattern: str, new: str) -> Column:
    """Edits that put `new` in place of each match of pattern (of the `re` module). A text is searched once, whatever the number of matches."""

    @F.pandas_udf(EDITS)
    def found(texts):
        import pandas as pd

        search = re.compile(pattern).finditer
        return pd.Series([None if t is None else [{"start": m.start(), "stop": m.end(), "new": new} for m in search(t)] for t in texts], dtype="object")

    return found(text)

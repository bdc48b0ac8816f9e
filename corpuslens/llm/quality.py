"""Quality rules as a short-circuit cascade.

Every document gets exact base statistics. Documents that pass the base test then run through further rules, one after the
other, until one rejects. The order of these rules comes from a sample of texts that pass the base test: each rule is timed, and of the
texts that the rules before it leave, the rule with most rejections per second runs next. A document is kept if no
rule rejects it, so the order changes the cost alone and never the verdict.

Nulls and texts without a word have no words and fail the base test. Repeated rows are judged each for itself; texts of any
length are read whole. Only the named columns are read, so further columns of any name do no harm. An empty table gives an
empty result, with the rules in the order in which they are declared.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"


class Text:
    """A text with the views of it that rules ask for, each made when first needed."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = self.text.encode("utf-8", "surrogatepass").split()  # splits at \x20 and \x09-\x0D alone
        self._lines: list[str] | None = None
        self._known: dict[Callable, int] = {}

    def once(self, statistic: Callable[[Text], int]) -> int:
        """A statistic of this text, made when first asked for."""
        if statistic not in self._known:
            self._known[statistic] = statistic(self)
        return self._known[statistic]

    @property
    def lines(self) -> list[str]:
        """Lines with a word."""
        if self._lines is None:
            self._lines = [x for x in self.text.split("\n") if x.strip(BLANKS)]
        return self._lines


def word_chars(t: Text) -> int:
    return len(t.text) - sum(t.text.count(c) for c in BLANKS)


def symbols(t: Text) -> int:
    return sum(t.text.count(c) for c in SYMBOLS)


def dup_lines(t: Text) -> int:
    return len(t.lines) - len(set(t.lines))


def repeat_words(t: Text, width: int = 3) -> int:
    """Words in windows of `width` words that are found twice or more in the text, the first occurrence included."""
    n = len(t.words)
    if n <= width:
        return 0
    number = dict(zip(dict.fromkeys(t.words), range(n), strict=False))
    ids = np.fromiter(map(number.__getitem__, t.words), np.int64, n)
    key = ids[: n - width + 1].copy()
    for k in range(1, width):  # pairs are numbered again at each step, so keys stay exact
        key = key * len(number) + ids[k : n - width + 1 + k]
        if k + 1 < width and len(number) ** (k + 2) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[k : k + len(key)] |= twice
    return int(covered.sum())


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


@dataclass(frozen=True)
class Rule:
    """rejects(text) is true for texts to drop."""

    name: str
    rejects: Callable[[Text], bool]


def _symbol_heavy(t: Text) -> bool:
    return t.once(symbols) > 0.1 * len(t.words)


def _word_length(t: Text) -> bool:
    return not 2 * len(t.words) <= t.once(word_chars) <= 15 * len(t.words)


def _repeated_lines(t: Text) -> bool:
    return t.once(dup_lines) > 0.5 * len(t.lines)


def _one_word_rules(t: Text) -> bool:
    return Counter(t.words).most_common(1)[0][1] > 0.3 * len(t.words)


def _shouted(t: Text) -> bool:
    return sum(w.isupper() and len(w) > 3 for w in t.words) > 0.5 * len(t.words)


def _few_letters(t: Text) -> bool:
    return sum(any(c.isalpha() for c in w.decode("utf-8", "replace")) for w in t.words) < 0.7 * len(t.words)


RULES = (
    Rule("symbol_heavy", _symbol_heavy),
    Rule("word_length", _word_length),
    Rule("repeated_lines", _repeated_lines),
    Rule("one_word_rules", _one_word_rules),
    Rule("shouted", _shouted),
    Rule("few_letters", _few_letters),
)


@dataclass
class Cascade:
    """Rules in the order in which they run, with what the sample said of them."""

    rules: tuple[Rule, ...] = RULES
    seen: dict[str, tuple[float, float]] = field(default_factory=dict)  # seconds a text, share rejected of what comes to the rule

    def rejects(self, t: Text) -> bool:
        return any(r.rejects(t) for r in self.rules)


def plan_cascade(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, seed: int = 7) -> Cascade:
    """Times each rule on about sample_rows documents, on the executors, and orders the rules by rejections per second.

    The sample decides on the order alone; the verdicts are the same in any order.
    """
    rows = df.count()
    share = min(1.0, sample_rows / max(1, rows))

    def measure(texts: list) -> dict[str, list]:
        ready = [x for x in map(Text, texts) if not base_failed(len(x.words), repeat_words(x))]
        hit, taken = [0] * len(ready), []
        for k, r in enumerate(rules):
            began = time.perf_counter_ns()
            for i, x in enumerate(ready):
                hit[i] |= bool(r.rejects(x)) << k
            taken.append(time.perf_counter_ns() - began)
        found = Counter(hit)
        return {"hit": [*found, *(-1 - k for k in range(len(rules)))], "n": [*found.values(), *taken]}

    sums = {r["hit"]: r["n"] for r in map_columns(df.sample(share, seed), [text], "hit long, n long", measure).groupBy("hit").agg(F.sum("n").alias("n")).collect()}  # at most 2**rules + rules rows
    return order(rules, {k: n for k, n in sums.items() if k >= 0}, [sums.get(-1 - k, 0) / 1e9 for k in range(len(rules))])


def order(rules: tuple[Rule, ...], hits: dict[int, int], seconds: list[float]) -> Cascade:
    """The cascade of rules by rejections per second, each counted on the texts that those before it leave.

    hits: texts by the rules that reject them, as bits; seconds: by rule, over all these texts.
    """
    total, passed, found, seen = sum(hits.values()), 0, [], {}
    while len(found) < len(rules) and total:
        left = {k: n for k, n in hits.items() if not k & passed}
        rejected = {k: sum(n for h, n in left.items() if h >> k & 1) for k in range(len(rules)) if not passed >> k & 1}
        best = max(rejected, key=lambda k: (rejected[k] / max(seconds[k], 1e-9), -seconds[k], -k))
        seen[rules[best].name] = (seconds[best] / total, rejected[best] / max(1, sum(left.values())))
        found.append(rules[best])
        passed |= 1 << best
    return Cascade(tuple(found) or rules, seen)


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", cascade: Cascade | None = None, **sample) -> DataFrame:
    """key, the base statistics, base_failed and kept, a row for each row of df."""
    cascade = cascade or plan_cascade(df, text, **sample)
    rules = Cascade(cascade.rules)

    def rows(keys: list, texts: list) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in (key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")}
        for k, x in zip(keys, texts, strict=True):
            t = Text(x)
            n, repeat = len(t.words), repeat_words(t)
            bad = base_failed(n, repeat)
            for c, v in zip(out, (k, n, t.once(word_chars), t.once(symbols), t.once(dup_lines), repeat, bad, not bad and not rules.rejects(t)), strict=True):
                out[c].append(v)
        return out

    kind = df.schema[key].dataType.simpleString()
    return map_columns(df, [key, text], f"`{key}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean", rows)


def keep_good(df: DataFrame, text: str = "text", cascade: Cascade | None = None, **sample) -> DataFrame:
    """The rows of df that every rule keeps, with df's own columns. No statistics are made beyond what a verdict needs."""
    cascade = cascade or plan_cascade(df, text, **sample)
    rules = Cascade(cascade.rules)

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd

        def one(x):
            t = Text(x)
            return len(t.words) >= 50 and not base_failed(len(t.words), repeat_words(t)) and not rules.rejects(t)

        return pd.Series([one(x) for x in texts], dtype="bool")

    return df.filter(good(F.col(f"`{text}`")))

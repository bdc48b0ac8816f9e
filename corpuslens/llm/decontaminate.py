"""Benchmark decontamination: rare n-gram seeds, then local alignment by Smith and Waterman.

Each test item is cut into n-grams of lower-cased words. The words of the test items are counted over the whole corpus; the product of its
words' frequencies says how much an n-gram tells. Of every stretch of a few places an item keeps the rarest n-gram as a seed, so seeds lie
all over it, whatever the size of the corpus, and edits here and there leave some; items of under 2n words keep all. Longer ones also keep pairs of neighbours, the rarer one of every two and all rare ones,
which are looked up side by side and with one word between: an alignment of half an item's score with m of its n words has at most 2m - n
edits, so either two neighbours are side by side in it, or nearly every two have just one word between. Seeds are looked up in every document;
where the words of an item whose seeds meet about one diagonal tell enough together - one rare seed, or several common ones -
the item is aligned to that stretch of the document, and the best alignment's score, as a share of the item's score with itself, decides.

Test items are taken in blocks of at most block_items items and about block_chars characters, so what is broadcast is bounded whatever the
size of the benchmark; each block costs one pass over the corpus. Null and empty texts and items match nothing. Items of fewer words
than an n-gram are one seed as a whole. Repeated rows and items are treated each for itself; of equal alignments the first in the text
counts. Very long texts are read whole. Empty tables give an empty result. Only the named columns are read, so others can have any names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

#: The share of an item's own score from which a passage counts as a copy. Two words in ten may be edited; chance reaches 0.3.
LEAST_SCORE = 0.5
MARKS = b".,;:!?\"'()[]{}*#$%&|<>"


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words without marks."""
    return (text or "").lower().encode().translate(None, MARKS).split()


def numbers(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """The numbers of the text's words, -1 for words that aren't known."""
    words = tokens(text)
    return np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))


def align(item: np.ndarray, part: np.ndarray, match: float = 1.0, mismatch: float = -0.5, gap: float = -0.5) -> tuple[float, int, int]:
    """The best local alignment's score, and the first and last place of it in part (last exclusive).

    A row of the matrix at a time; the gap along a row is a running maximum, so each row is a few vector operations.
    """
    n = len(part)
    slope = -gap * np.arange(n + 1)
    above, begins = np.zeros(n + 1), np.arange(n + 1)
    best = (0.0, 0, 0)
    for word in item:
        diagonal = above[:-1] + np.where(part == word, match, mismatch)
        score, begin = np.zeros(n + 1), np.arange(n + 1)
        up = above[1:] + gap
        score[1:] = np.maximum(0, np.maximum(diagonal, up))
        took = diagonal >= up
        begin[1:] = np.where(score[1:] > 0, np.where(took, begins[:-1], begins[1:]), begin[1:])
        lifted = score + slope
        top = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted >= top, np.arange(n + 1), 0))
        score, begin = top - slope, begin[at]
        begin = np.where(score > 1e-9, begin, np.arange(n + 1))
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (float(score[j]), int(begin[j]), j)
        above, begins = score, begin
    return best


def mixed(columns) -> np.ndarray:
    """One number for each n-gram, from its words' numbers; equal n-grams have equal ones."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = (out + c.astype(np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Table:
    """Seeds of one size: sorted numbers of grams, and for each the items and places where it is a seed."""

    def __init__(self, size: int, grams: list[tuple], items: list[int], places: list[int], tells: list[float]):
        self.size = size
        keys = mixed(np.array(grams, np.int64).T)
        order = np.argsort(keys, kind="stable")
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.items, self.places, self.tells = np.array(items, np.int64)[order], np.array(places, np.int64)[order], np.array(tells)[order]
        self.shift = np.uint64(64 - min(26, max(10, (16 * len(self.keys)).bit_length())))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)  # most words of a corpus end here
        self.maybe[self.keys >> self.shift] = True

    def find(self, words: np.ndarray, known: np.ndarray, apart: int) -> tuple[np.ndarray, ...]:
        """(item, place in the item, diagonal, size, what it tells) of each seed whose words stand `apart` places from each other in the text."""
        n = len(words) - (self.size - 1) * apart
        at = np.flatnonzero(np.logical_and.reduce([known[j * apart : j * apart + n] for j in range(self.size)])) if n > 0 else np.zeros(0, np.int64)
        keys = mixed([words[at + j * apart] for j in range(self.size)])
        near = self.maybe[keys >> self.shift]
        at, keys = at[near], keys[near]
        slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        near = self.keys[slot] == keys
        at, slot = at[near], slot[near]
        count = self.count[slot]
        each = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[slot], count)
        return self.items[each], self.places[each], np.repeat(at, count) - self.places[each], np.full(len(each), self.size), self.tells[each]


class Seeds:
    """Test items of one block with their words, seeds and the numbers that words have."""

    def __init__(self, items: list[tuple], n: int):
        self.keys = [k for k, _ in items]
        texts = [tokens(t) for _, t in items]
        self.known = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.items = [np.array([self.known[w] for w in t], np.int64) for t in texts]
        self.n = n

    def choose(self, counts: np.ndarray, total: int, enough: float, stretch: int = 3) -> None:
        """self.tables: the rarest pair of each two places and all that tell 0.8 of enough, and the rarest n-gram of each `stretch` places (all n-grams of short items), by size; self.told: by item, what each word tells;
        self.needed: what a diagonal must tell, `enough` and the logarithm of the number of the item's seeds, or half of all that they tell."""
        tell = -np.log(np.maximum(counts, 1) / max(total, 1))
        self.told = [tell[x] for x in self.items]
        self.needed = np.zeros(len(self.items))
        self.longest = max(map(len, self.items), default=0)
        self.slack = np.array([len(x) // 2 + 3 for x in self.items], np.int64)
        found: dict[int, tuple[list, list, list, list]] = defaultdict(lambda: ([], [], [], []))
        for i, x in enumerate(self.items):
            if not len(x):
                continue
            steps = {min(self.n, len(x)): 1} if len(x) < 2 * self.n else {2: 2, self.n: stretch}
            words, held, before = x.tolist(), np.zeros(len(x), bool), sum(len(rows[0]) for rows in found.values())
            for size, step in steps.items():
                each = np.convolve(self.told[i], np.ones(size), "valid")
                chosen = {j + int(each[j : j + step].argmax()) for j in range(0, len(each), step)}
                if size == 2:
                    chosen |= set(np.flatnonzero(each >= 0.8 * enough).tolist())
                rows = found[size]
                for j in sorted(chosen):
                    for row, x in zip(rows, (tuple(words[j : j + size]), i, j, float(each[j])), strict=True):
                        row.append(x)
                    held[j : j + size] = True
            chances = sum(len(rows[0]) for rows in found.values()) - before
            self.needed[i] = min(enough + float(np.log(chances)), 0.5 * self.told[i][held].sum())
        self.tables = [Table(size, *rows) for size, rows in found.items()]


def _stretches(s: Seeds, words: np.ndarray, begins: np.ndarray) -> dict[tuple[int, int], list[list[int]]]:
    """By text and item, the [lowest, highest] diagonals of the places where the item's seeds tell enough."""
    known = words >= 0
    hits = [t.find(words, known, apart) for t in s.tables for apart in ((1, 2) if t.size == 2 else (1,))]
    if not sum(len(h[0]) for h in hits):
        return {}
    item, place, diagonal, size, tells = map(np.concatenate, zip(*hits, strict=True))
    group = (np.searchsorted(begins, diagonal + place, side="right") - 1) * len(s.items) + item
    line = group * np.int64(len(words) + 3 * s.longest + 10) + diagonal
    order = np.argsort(line)
    item, place, diagonal, size, tells, group, line = (x[order] for x in (item, place, diagonal, size, tells, group, line))
    # an upper bound for each window of `slack` diagonals, in which a word may count several times; few windows pass without a copy
    sums = np.concatenate([[0.0], np.cumsum(tells)])
    end = np.searchsorted(line, line + s.slack[item], side="right")
    out: dict[tuple[int, int], list[list[int]]] = {}
    for k in np.flatnonzero(sums[end] - sums[:-1] >= s.needed[item] - 1e-9).tolist():
        i, e = int(item[k]), int(end[k])
        if tells[k] < s.needed[i] - 1e-9:
            places = {x for j, n in zip(place[k:e].tolist(), size[k:e].tolist(), strict=True) for x in range(j, j + n)}
            if s.told[i][list(places)].sum() < s.needed[i] - 1e-9:
                continue
        low, high = int(diagonal[k]), int(diagonal[e - 1])
        found = out.setdefault(divmod(int(group[k]), len(s.items)), [])
        if found and low <= found[-1][1] + s.slack[i]:
            found[-1][1] = max(high, found[-1][1])
        else:
            found.append([low, high])
    return out


def may_align(item: np.ndarray, part: np.ndarray, least_score: float, marks: np.ndarray) -> bool:
    """marks: false for each known word, and at its end for unknown ones. Whether part has enough of the item's words close together: a score of s times n with m matches has at most 2 (m - s n) edits, so s n
    matches lie within (3 - 2 s) n words."""
    need, wide = least_score * len(item), int((3 - 2 * least_score) * len(item)) + 1
    marks[item] = True
    sums = np.zeros(len(part) + 1, np.int64)
    np.cumsum(marks[part], out=sums[1:])
    marks[item] = False
    return int((sums[wide:] - sums[:-wide]).max() if len(sums) > wide else sums[-1]) >= need - 1e-9


def _blocks(s: Seeds, texts: list[str | None], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(the first text's number, words of one text after the other, their begins and ends): texts of about `most` words, so that one look serves many.

    Two unknown words stand behind each text, so no seed reaches from one into the next.
    """
    parts, at, first = [], 0, 0
    begins, ends = [], []
    for k, text in enumerate(texts):
        words = numbers(text, s.known)
        begins.append(at)
        ends.append(at + len(words))
        parts += [words, np.full(2, -1)]
        at += len(words) + 2
        if at >= most or k == len(texts) - 1:
            yield first, np.concatenate(parts), np.array(begins), np.array(ends)
            parts, begins, ends, at, first = [], [], [], 0, k + 1


def _hits(s: Seeds, texts: list[str | None], least_score: float = LEAST_SCORE, most: int = 100_000) -> list[tuple]:
    """(number of the text, item, score, first and last word) of each item that aligns with a text, with a score of least_score and more."""
    out, marks = [], np.zeros(len(s.known) + 1, bool)
    for first, words, begins, ends in _blocks(s, texts, most) if s.tables else ():
        for (text, item), stretches in _stretches(s, words, begins).items():
            x, slack, best, begin, end = s.items[item], int(s.slack[item]), (0.0, 0, 0), int(begins[text]), int(ends[text])
            for low, high in stretches:
                a, b = max(begin, low - slack), min(end, high + len(x) + slack)
                if not may_align(x, words[a:b], least_score, marks):
                    continue
                score, i, j = align(x, words[a:b])
                if score > best[0]:
                    best = (score, a + i - begin, a + j - begin)
            if best[0] / len(x) >= least_score:
                out.append((first + text, item, best[0] / len(x), best[1], best[2]))
    return out


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    n: int = 3, least_score: float = LEAST_SCORE, block_items: int = 20_000, block_chars: int = 16_000_000,
) -> DataFrame:
    """key, item_key, score (of the item's full score), first_word and last_word (exclusive), for scores of least_score and more."""
    spark = docs.sparkSession
    size = benchmark.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.char_length(item_text)), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-size["chars"] // block_chars))
    kinds = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item_key}` {benchmark.schema[item_key].dataType.simpleString()}"
    schema = f"{kinds}, score double, first_word long, last_word long"
    found = None
    for block in range(blocks):
        part = benchmark.select(item_key, item_text).filter(F.col(item_text).isNotNull())
        if blocks > 1:
            part = part.filter(F.pmod(F.xxhash64(item_key, item_text), F.lit(blocks)) == block)
        s = Seeds([(r[0], r[1]) for r in part.collect()], n)  # about block_items items and block_chars characters
        known = spark.sparkContext.broadcast(s.known)

        def tally(texts: list, known=known) -> dict[str, list]:
            sums, all_words = np.zeros(len(known.value), np.int64), 0
            for t in texts:
                ids = numbers(t, known.value)
                all_words += len(ids)
                sums += np.bincount(ids[ids >= 0], minlength=len(sums))
            at = np.flatnonzero(sums)
            return {"word": [-1, *at.tolist()], "n": [all_words, *sums[at].tolist()]}

        sums = {r["word"]: r["n"] for r in map_columns(docs, [text], "word long, n long", tally).groupBy("word").agg(F.sum("n").alias("n")).collect()}  # one row for each word of the block
        # one chance meeting of an item in a thousand words is cheap beside reading them
        s.choose(np.array([sums.get(i, 0) for i in range(len(s.known))]), sums.get(-1, 0), float(np.log(1000 * max(1, len(s.items)))))
        shared = spark.sparkContext.broadcast(s)

        def scan(keys: list, texts: list, shared=shared) -> dict[str, list]:
            s = shared.value
            rows = [(keys[k], s.keys[i], score, a, b) for k, i, score, a, b in _hits(s, texts, least_score)]
            return dict(zip((key, item_key, "score", "first_word", "last_word"), map(list, zip(*rows, strict=True)), strict=True)) if rows else dict.fromkeys((key, item_key, "score", "first_word", "last_word"), [])

        hits = map_columns(docs, [key, text], schema, scan)
        found = hits if found is None else found.unionByName(hits)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that align with no test item; rows without a key stay."""
    bad = contaminated(docs, benchmark, key, **options).select(F.col(key).alias("_bad")).distinct()
    return docs.join(bad, docs[key] == bad["_bad"], "left_anti")

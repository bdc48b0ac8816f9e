"""Best-fit packing of tokenized documents into sequences of fixed length.

Documents longer than a sequence are cut into whole sequences behind a first piece that may be shorter. What is left is a
bin-packing problem over at most `length` piece lengths, whatever the number of documents. Its configuration linear program
is solved on the driver from the length histogram (at most `length` counts): multiplicative weights give each length a price, a
knapsack dynamic program finds the configurations of highest worth under these prices, and the weighted configurations are
rounded to whole sequences. What rounding leaves over is packed best-fit. Pieces then take their places in the plan by
their rank among the pieces of the same length, which Spark computes from counts per bucket, so no length is ever gathered in one task.

Null texts count as empty and make one piece of the end id. Repeated rows are packed each for itself; ties of length go by key. An empty
table gives an empty result. Only the named columns are read, so others can have any names; a text is tokenized whole, in stretches cut where the tokenizer cuts anyway.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, map_columns

_BESIDE_SPACE = re.compile(r"\s | \s")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= \S)")


#: Fixed value: the special token of the vocabulary, with the number behind all others.
END_OF_TEXT = "<|endoftext|>"


def stretches(text: str) -> list[str]:
    """text cut before single spaces between other characters. A byte-level pre-tokenizer cuts there too, so ids just add up."""
    if "\0" in text or _BESIDE_SPACE.search(text):
        return _BEFORE_SPACE.split(text)
    return text.replace(" ", "\0 ").split("\0")


class Encoder(dict):
    """Ids of stretches as little-endian bytes, remembered up to `most` stretches. vocabulary: a tokenizers or a tiktoken file.

    The same vocabulary gives the same ids by either library; tiktoken takes a third of the time for short stretches.
    """

    def __init__(self, vocabulary: str, most: int = 400_000):
        self.most = most
        if vocabulary.endswith(".tiktoken"):
            import base64

            import public_tokenizers
            import tiktoken

            with open(vocabulary, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            end = [len(ranks)]
            # the tokenizers library takes this string out of a text before anything else
            self.ids = lambda s: plain(s) if END_OF_TEXT not in s else [i for k, part in enumerate(s.split(END_OF_TEXT)) for i in ((end if k else []) + plain(part))]
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(vocabulary)
            self.ids = lambda s: t.encode(s, add_special_tokens=False).ids

    def __missing__(self, stretch: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        got = self[stretch] = np.asarray(self.ids(stretch), "<u4").tobytes() if len(stretch) > 100 else array("I", self.ids(stretch)).tobytes()
        return got

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, stretches(text)))


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One for each Python worker, which keeps what it remembers from task to task."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def pieces(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", length: int = 1024, end_id: int = 2) -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(keys: list, texts: list) -> dict[str, list]:
        encode = encoder(vocabulary).encode
        out: dict[str, list] = {k: [] for k in (key, "piece", "start", "length", "ids_crc32")}
        for k, x in zip(keys, texts, strict=True):
            ids = encode(x or "") + end
            n, at = len(ids) // 4, 0
            first = n % length or length
            for piece in range(-(-n // length)):
                to = first + piece * length
                for c, v in zip(out, (k, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to])), strict=True):
                    out[c].append(v)
                at = to
        return out

    kind = df.schema[key].dataType.simpleString()
    return map_columns(df, [key, text], f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long", cut)


def _price(y: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the best worth for each room up to capacity, and the length taken last (0: none)."""
    sizes = np.flatnonzero(y > 0)
    worth, best, last = y[sizes], np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        k = np.searchsorted(sizes, c, "right")
        best[c] = best[c - 1]
        if k:
            v = (worth[:k] + best[c - sizes[:k]])[::-1]
            j = k - 1 - int(v.argmax())  # of equals the longest, as short pieces fill gaps later
            v = v[::-1]
            if v[j] > best[c] + 1e-15:
                best[c], last[c] = v[j], sizes[j]
    return best, last


def _read_back(last: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        if last[room]:
            out.append(int(last[room]))
            room -= int(last[room])
        else:
            room -= 1
    return out


def configurations(demand: np.ndarray, capacity: int, rounds: int = 2, eta: float = 0.5) -> tuple[list[tuple[tuple[tuple[int, int], ...], float]], float]:
    """A fractional cover of demand (pieces by length) as [(configuration, weight)], by multiplicative weights, and a lower bound.

    A round packs all pieces, as fractions of any size. The dynamic program prices all configurations at once; each length, the
    longest first, goes with the pieces of highest worth beside it, as far as these last, and prices are taken anew over what is left. Lengths
    whose sequences were left with gaps are dearer in the next round, so they are placed earlier. The mean over rounds is the cover.
    Prices divided by the worth of the best configuration are a solution of the dual program, so their worth over all
    pieces bounds the number of sequences from below.
    """
    sizes = np.flatnonzero(demand)
    if not len(sizes):
        return [], 0.0
    bound, dear = 0.0, np.ones(len(demand))
    weight: dict[tuple, float] = defaultdict(float)
    for _ in range(rounds):
        left, gaps, stuck = demand.astype(float), np.zeros(len(demand)), False
        while len(open_sizes := np.flatnonzero(left > 1e-9)):
            y = np.zeros(len(demand))
            y[open_sizes] = open_sizes / capacity * dear[open_sizes]
            best, last = _price(y, capacity)
            if len(open_sizes) == len(sizes):
                bound = max(bound, float(demand[sizes] @ y[sizes] / best[capacity]))
            moved = False
            for s in open_sizes[::-1].tolist():
                if left[s] <= 1e-9:
                    continue
                counts: dict[int, int] = defaultdict(int)
                for x in (s, *_read_back(last, capacity - s)):
                    counts[x] += 1
                if any(left[x] <= 1e-9 for x in counts):
                    continue  # these prices are out of date
                step = min(left[x] / n for x, n in counts.items())
                weight[tuple(sorted(counts.items(), reverse=True))] += step
                gap = 1 - sum(x * n for x, n in counts.items()) / capacity
                for x, n in counts.items():
                    left[x] -= step * n
                    gaps[x] += step * n * gap
                moved = True
            assert moved
        dear *= np.exp(eta * gaps / np.maximum(demand, 1))
    return [(c, w / rounds) for c, w in weight.items()], bound


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit by falling length, in bulk: bins with the same contents are one entry, so the work doesn't grow with the counts."""
    by_room: dict[int, list[tuple[tuple, int]]] = defaultdict(list)  # room left: [(contents, bins)]
    for s in sorted(left, reverse=True):
        n = left[s]
        for room in sorted(r for r in by_room if r >= s):
            while n and by_room[room]:
                held, bins = by_room[room].pop()
                each = min(room // s, n)
                used = min(bins, n // each)
                by_room[room - each * s].append(((*held, (s, each)), used))
                if bins > used:
                    by_room[room].append((held, bins - used))
                n -= used * each
            if not n:
                break
        each = capacity // s
        if n >= each:
            by_room[capacity - each * s].append((((s, each),), n // each))
        if n % each:
            by_room[capacity - n % each * s].append((((s, n % each),), 1))
        for room in [r for r, x in by_room.items() if not x]:
            del by_room[room]
    return [x for room in sorted(by_room) for x in by_room[room]]


def rounded(demand: np.ndarray, capacity: int, share: float, solves: int = 2, **options) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(configuration, sequences)] that holds every piece exactly once.

    The linear program is solved, and of its configurations without a gap the share `share` is taken, rounded to whole sequences as far
    as pieces last. It is solved again over what is left, and the rest goes best-fit.
    """
    left = demand.astype(np.int64)
    out: dict[tuple, int] = defaultdict(int)
    for _ in range(solves if share else 0):
        full = sorted(((c, w) for c, w in configurations(left, capacity, **options)[0] if sum(s * n for s, n in c) == capacity), reverse=True)
        # each prefix of the sum is rounded, so neighbours make up for each other and what is left keeps the mixture of lengths
        ends = np.floor(share * np.cumsum([w for _, w in full]) + 0.5).astype(np.int64)
        taken = 0
        for (c, _), times in zip(full, np.diff(ends, prepend=0).tolist(), strict=True):
            times = min(times, *(int(left[s]) // n for s, n in c))
            if times > 0:
                out[c] += times
                taken += times
                for s, n in c:
                    left[s] -= n * times
        if not taken:
            break
    return [*out.items(), *_best_fit({int(s): int(left[s]) for s in np.flatnonzero(left)}, capacity)]


def plan(demand: np.ndarray, capacity: int, shares: tuple[float, ...] = (0.9, 0.6, 0.0), spare: float = 0.001, **options) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """The rounded plan of fewest sequences among these shares of the linear program's configurations; the first that comes within
    `spare` of the least possible number ends the search. With very few pieces, rounding costs most, and a smaller share is better."""
    least = -(-int((demand * np.arange(len(demand))).sum()) // capacity)
    best: list[tuple[tuple[tuple[int, int], ...], int]] | None = None
    for share in shares:
        got = rounded(demand, capacity, share, **options)
        if best is None or sum(n for _, n in got) < sum(n for _, n in best):
            best = got
        if sum(n for _, n in best) <= least * (1 + spare) + 1:
            break
    return best or []


def places(cut: DataFrame, length: int = 1024, key: str = "doc_id", buckets: int = 256) -> DataFrame:
    """cut with sequence_id and offset. cut must give the same rows each time it is read (see durable)."""
    spark = cut.sparkSession
    full = cut.filter(F.col("length") >= length)
    short = cut.filter(F.col("length") < length).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    counts = short.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), "_n")  # at most length x buckets rows
    base = durable(base, "pack-counts")
    demand = np.zeros(length + 1, np.int64)
    for r in base.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most `length` rows
        demand[r["length"]] = r["n"]
    starts, slots = defaultdict(list), defaultdict(list)  # by length: the first rank of each entry; its sequence, pieces a sequence, offset
    sequence, given = 0, defaultdict(int)
    for contents, times in plan(demand, length):
        offset = 0
        for s, n in contents:
            starts[s].append(given[s])
            slots[s].append((sequence, n, offset))
            given[s] += n * times
            offset += n * s
        sequence += times
    table = {s: (np.array(starts[s]), np.array(slots[s])) for s in starts}
    shared = spark.sparkContext.broadcast(table)  # its size depends on `length` alone

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths, ranks):
        import pandas as pd

        out = np.zeros((len(lengths), 2), np.int64)
        sizes, rank = lengths.to_numpy(), ranks.to_numpy()
        for s in np.unique(sizes):
            at = np.flatnonzero(sizes == s)
            first, slot = shared.value[int(s)]
            k = np.searchsorted(first, rank[at], "right") - 1
            within, (seq, n, offset) = rank[at] - first[k], slot[k].T
            out[at, 0] = seq + within // n
            out[at, 1] = offset + within % n * s
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    rank = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(key, "piece", "ids_crc32")) - 1
    placed = (
        short.withColumn("_rank", rank)
        .join(base.drop("_n"), ["length", "_bucket"])  # both sides are dealt out by length and bucket already
        .withColumn("_place", place("length", (F.col("_rank") + F.col("_before")).cast("long")))
        .select(*cut.columns, "_place.sequence_id", "_place.offset")
    )
    alone = full.select(*cut.columns, (F.lit(sequence) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone)


def pack(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", length: int = 1024, end_id: int = 2) -> DataFrame:
    """A row for each piece with its place: key, piece, start, length, ids_crc32, sequence_id, offset."""
    return places(durable(pieces(df, vocabulary, key, text, length, end_id), "pack-pieces"), length, key)

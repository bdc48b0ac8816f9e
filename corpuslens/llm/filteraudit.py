"""How filters of a cascade act on each other, in every order, by wide packed counters.

A document's mask has a bit for each filter that it fails. For a mask, what every step of every order of the filters does to the document is
known beforehand: with five filters 120 orders of five steps. One big integer holds it all, a field of 64 bits for each counter of each
step. Equal masks of a part are counted before the shuffle; a part's integer is the sum of its documents' integers (a count
times a mask's integer is that sum), and since no counter reaches 2**64 no field runs over into the next. It is unpacked once a part.

So one pass over the masks gives all orders, and what is shuffled is a few counts a part and task, however many documents there are.

Null texts are empty; a null part is the empty string. Repeated rows count each; a document is no copy of one with its own id. Rows without an id are
copies of none and make none. Documents without a label are neither good nor toxic; where an id has several labels any of them counts.
Texts of any length are read whole. Only the named columns are read, so others can have any names. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

COUNTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
BLANK = r"[\x20\x09-\x0D]+"


def orders(n: int) -> list[tuple[int, ...]]:
    return list(itertools.permutations(range(n)))


@functools.cache
def integer(mask: int, good: bool, toxic: bool, n: int) -> int:
    """The counters of one document with this mask: for each order and step, in this sequence, a field for each of COUNTERS."""
    fields = []
    for order in orders(n):
        gone = False
        for f in order:
            fails = bool(mask >> f & 1)
            here = fails and not gone
            fields += [not fails and not gone, here, fails and gone, mask == 1 << f, here and good, here and toxic]
            gone |= fails
    return int.from_bytes(np.array(fields, "<u8").tobytes(), "little")


def unpacked(total: int, n: int) -> np.ndarray:
    """The fields of a sum of integers: a row for each order and step, a column for each of COUNTERS."""
    rows = len(orders(n)) * n
    return np.frombuffer(total.to_bytes(8 * rows * len(COUNTERS), "little"), "<u8").reshape(rows, len(COUNTERS))


def failures(words: Column, text: Column) -> list[Column]:
    """The failure conditions of a text by itself: too short, too few distinct words, too many capitals, symbols."""
    n = F.size(words)
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))
    return [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * capitals > 10 * F.char_length(text), text.rlike(r"[#$%&*|]")]


def masks(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask (a bit for each filter, the first is the lowest), good and toxic of each row of df; the last filter is for copies of a smaller id."""
    t = F.coalesce(df[text], F.lit(""))
    rows = df.select(df[key].alias("_key"), F.coalesce(df[part].cast("string"), F.lit("")).alias("part"), t.alias("_text"))
    rows = rows.withColumn("_words", F.filter(F.split("_text", BLANK), lambda w: w != ""))
    own = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failures(F.col("_words"), F.col("_text")))), F.lit(0))
    copies = len(failures(F.lit(None), F.lit("")))
    rows = durable(rows.select("_key", "part", own.alias("_own"), F.xxhash64("_text").alias("_h"), F.xxhash64(F.lit("second"), "_text").alias("_g")), "audit-masks")
    first = rows.filter("_key is not null").groupBy("_h", "_g").agg(F.min("_key").alias("_first"), F.max("_key").alias("_last")).filter("_first < _last").drop("_last")
    first = durable(first, "audit-first")  # a table of its own, so that the join of a text with very many copies can be split
    told = labels.groupBy(labels["doc_id"].alias("_doc")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    found = rows.join(first, ["_h", "_g"], "left").join(told, F.col("_key") == F.col("_doc"), "left")
    copy = F.when(F.col("_key") > F.col("_first"), 1 << copies).otherwise(0)
    return found.select("part", (F.col("_own") + copy).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def audit(found: DataFrame, names: str = "ABCDE") -> DataFrame:
    """part, filter_order, step, COUNTERS and shapley for each part of found (part, mask, good, toxic), order of the filters and step.

    names: a letter for each filter, in the order of the mask's bits. shapley: what a step's filter removes, summed over all orders.
    """
    n = len(names)
    counts = found.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("seen"))  # four rows a mask at most
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*COUNTERS, "shapley"))
    told, steps = ["".join(names[f] for f in o) for o in orders(n) for _ in o], [s + 1 for _ in orders(n) for s in range(n)]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array([f for o in orders(n) for f in o])
        for batch in batches:
            for row in batch.to_pylist():
                fields = unpacked(sum(x["n"] * integer(x["mask"], x["good"], x["toxic"], n) for x in row["seen"]), n).astype(np.int64)
                removed = np.zeros(n, np.int64)
                np.add.at(removed, at, fields[:, COUNTERS.index("removed")])
                columns = [pa.array([row["part"]] * len(told), pa.string()), pa.array(told), pa.array(steps, pa.int32()), *map(pa.array, fields.T.copy()), pa.array(removed[at])]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *COUNTERS, "shapley"])

    return parts.mapInArrow(job, schema)

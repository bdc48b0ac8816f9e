"""Removal of repeated passages, found by super-k-mers.

A window is `window` consecutive words of a document. Its minimiser is the least hash of the `gram`-word runs in it, so equal windows have equal
minimisers. Consecutive windows with one minimiser (a super-k-mer) travel together, as the one string of their words, to the bucket
of the minimiser. There the distinct strings are cut into windows, and sorting brings equal windows together: the least
document of each is known exactly, by the words themselves. A word goes if a window that covers it also starts in a document with a smaller id.

What travels is cut down before: documents of equal words are one class, of which the one with the least id stands for the others; a minimiser that
one class alone has can't lie in a repeated window; equal strings travel once, with the least id of their documents. A bucket of more than `most`
windows (a passage that very many different texts share) isn't gathered: its windows go on one by one, each under 128 bits of its words, and their
least documents are summed up before the shuffle.

Null texts, and texts with fewer words than a window, have none and stay as they are; so do rows without an id, which make no other row's words
go either. Documents are told apart by id alone: rows with one id never take words from each other. Texts of any length are read whole; their super-k-mers
are cut at 256 windows. Only the named columns are read, so others can have any names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, discard, durable, map_columns

_HASHES = WordHashes()
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LONGEST = 256
NOTHING = hashlib.sha256().hexdigest()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # splits at \x20 and \x09-\x0D alone


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` consecutive numbers, by doubling."""
    n, reach = len(x) - width + 1, 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[:n], x[width - reach : width - reach + n])


def minimisers(words: list[bytes], window: int, gram: int) -> np.ndarray:
    """The minimiser of each window, as a signed number."""
    if len(words) < window:
        return np.zeros(0, np.int64)
    x, n = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)), len(words) - gram + 1
    runs = np.zeros(n, np.uint64)
    for k in range(gram):
        runs *= _MULTIPLIER
        runs += x[k : k + n]
    return _least(_mixed(runs), window - gram + 1).view(np.int64)


def super_kmers(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first windows and the numbers of windows of the runs of one minimiser, cut at _LONGEST."""
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
    ends = np.r_[starts[1:], len(found)]
    if (ends - starts).max() > _LONGEST:
        starts = np.concatenate([np.arange(a, b, _LONGEST) for a, b in zip(starts, ends, strict=True)])
        ends = np.r_[starts[1:], len(found)]
    return starts, ends - starts


def prints(df: DataFrame, key: str, text: str, window: int, gram: int) -> DataFrame:
    """_key, _c1 and _c2 (the class), n_words, sha256 (of the words joined by single spaces) and the distinct _minimisers of each row."""

    def rows(keys: list, texts: list) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("_key", "_c1", "_c2", "n_words", "sha256", "_minimisers")}
        for k, t in zip(keys, texts, strict=True):
            words = words_of(t)
            joined = b" ".join(words)
            cls = np.frombuffer(xxhash.xxh3_128_digest(joined), np.int64).tolist()
            mins = np.unique(minimisers(words, window, gram)) if k is not None else np.zeros(0, np.int64)
            for c, v in zip(out, (k, *cls, len(words), hashlib.sha256(joined).hexdigest(), mins), strict=True):
                out[c].append(v)
        return out

    kind = df.schema[key].dataType.simpleString()
    return map_columns(df, [key, text], f"_key {kind}, _c1 long, _c2 long, n_words long, sha256 string, _minimisers array<long>", rows)


def _strings(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """_key, _c1, _c2, _at, _n, _min and _packed of the super-k-mers of texts (_key, _c1, _c2, _text, _wanted) with a wanted minimiser."""

    def rows(keys: list, c1: list, c2: list, texts: list, wanted: list) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("_key", "_c1", "_c2", "_at", "_n", "_min", "_packed")}
        for k, a, b, t, w in zip(keys, c1, c2, texts, wanted, strict=True):
            words = words_of(t)
            found = minimisers(words, window, gram)
            starts, sizes = super_kmers(found)
            own = np.isin(found[starts], np.asarray(w, np.int64))
            for at, n in zip(starts[own].tolist(), sizes[own].tolist(), strict=True):
                for c, v in zip(out, (k, a, b, at, n, int(found[at]), b" ".join(words[at : at + n + window - 1]).decode("utf-8", "surrogatepass")), strict=True):
                    out[c].append(v)
        return out

    return map_columns(texts, ["_key", "_c1", "_c2", "_text", "_wanted"], f"_key {texts.schema['_key'].dataType.simpleString()}, _c1 long, _c2 long, _at long, _n int, _min long, _packed string", rows)


def first_documents(strings: list[str], firsts: list, window: int) -> list[list]:
    """For each window of each string of a bucket, the least of the documents `firsts` of all strings that hold it, by sorting."""
    number: dict[str, int] = {}
    ids = [np.fromiter((number.setdefault(w, len(number)) for w in s.split(" ")), np.uint32, s.count(" ") + 1) for s in strings]
    cut = [np.lib.stride_tricks.sliding_window_view(x, window) for x in ids]
    rows = np.ascontiguousarray(np.concatenate(cut)).view(np.dtype((np.void, 4 * window))).ravel()
    order = np.argsort(rows, kind="stable")
    new = np.r_[True, rows[order[1:]] != rows[order[:-1]]]
    owner = np.repeat(np.asarray(firsts), [len(x) for x in cut])
    least = np.empty_like(owner)
    least[order] = np.minimum.reduceat(owner[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return [x.tolist() for x in np.split(least, np.cumsum([len(x) for x in cut])[:-1])]


def _verdicts(strings: DataFrame, window: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """(_min, _packed and _firsts, the least document of each window, for the distinct strings (_min, _packed, _n, _key); the tables that it reads)."""
    kind = strings.schema["_key"].dataType.simpleString()
    distinct = durable(strings.groupBy("_min", "_packed", "_n").agg(F.min("_key").alias("_first")), "kmer-strings")
    sizes = distinct.groupBy("_min").agg(F.sum("_n").alias("_windows"), F.count("*").alias("_strings"))
    sized = distinct.join(sizes, "_min")
    buckets = sized.filter((F.col("_windows") <= most) & (F.col("_strings") > 1)).groupBy("_min").agg(F.collect_list(F.struct("_packed", "_first")).alias("_b"))

    def sort(mins: list, buckets: list) -> dict[str, list]:
        out: dict[str, list] = {"_min": [], "_packed": [], "_firsts": []}
        for m, b in zip(mins, buckets, strict=True):
            packed = [x["_packed"] for x in b]
            out["_min"] += [m] * len(b)
            out["_packed"] += packed
            out["_firsts"] += first_documents(packed, [x["_first"] for x in b], window)
        return out

    schema = f"_min long, _packed string, _firsts array<{kind}>"
    small = map_columns(buckets, ["_min", "_b"], schema, sort)
    alone = sized.filter("_strings = 1").select("_min", "_packed", F.array_repeat("_first", F.col("_n")).alias("_firsts"))
    large = durable(sized.filter((F.col("_windows") > most) & (F.col("_strings") > 1)).select("_min", "_packed", "_first"), "kmer-large")
    if large.isEmpty():
        return small.unionByName(alone), [distinct, large]

    def single(mins: list, strings: list, firsts: list) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("_h", "_g", "_s1", "_s2", "_place", "_first")}
        for s, f in zip(strings, firsts, strict=True):
            words = s.encode("utf-8", "surrogatepass").split(b" ")
            s1, s2 = np.frombuffer(xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass")), np.int64).tolist()
            for i in range(len(words) - window + 1):
                h, g = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words[i : i + window])), np.int64).tolist()
                for c, v in zip(out, (h, g, s1, s2, i, f), strict=True):
                    out[c].append(v)
        return out

    each = durable(map_columns(large, ["_min", "_packed", "_first"], f"_h long, _g long, _s1 long, _s2 long, _place int, _first {kind}", single), "kmer-windows")
    least = durable(each.groupBy("_h", "_g").agg(F.min("_first").alias("_least")), "kmer-least")  # a table of its own, so that a window in very many strings is a join that can be split
    listed = each.join(least, ["_h", "_g"]).groupBy("_s1", "_s2").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_least"))), lambda x: x["_least"]).alias("_firsts"))

    def named(mins: list, strings: list) -> dict[str, list]:
        got = [np.frombuffer(xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass")), np.int64).tolist() for s in strings]
        return {"_min": mins, "_packed": strings, "_s1": [a for a, _ in got], "_s2": [b for _, b in got]}

    whole = map_columns(large, ["_min", "_packed"], "_min long, _packed string, _s1 long, _s2 long", named).join(listed, ["_s1", "_s2"]).select("_min", "_packed", "_firsts")
    return small.unionByName(alone).unionByName(whole), [distinct, large, each, least]


def merged(starts: list[int], window: int) -> list[tuple[int, int]]:
    """The ranges of words (from, to) that the windows at sorted `starts` cover."""
    x = np.asarray(starts, np.int64)
    new = np.flatnonzero(np.r_[True, x[1:] > x[:-1] + window])
    return list(zip(x[new].tolist(), (x[np.r_[new[1:] - 1, len(x) - 1]] + window).tolist(), strict=True)) if len(x) else []


class Repeats:
    """What `repeats` finds: prints (a row for each row of df), classes (_c1, _c2, _rep), spans (_key, _c1, _c2, _spans; of representatives) and texts (of these)."""

    def __init__(self, prints: DataFrame, classes: DataFrame, spans: DataFrame, texts: DataFrame, window: int):
        self.prints, self.classes, self.spans, self.texts, self.window = prints, classes, spans, texts, window

    def removed(self) -> DataFrame:
        """_key, _c1, _c2, n_words, sha256 and _spans, the ranges of words to remove, for each row; where there are none, they are null or empty."""
        whole = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("n_words").alias("to")))
        found = self.prints.join(self.classes, ["_c1", "_c2"], "left").join(self.spans.withColumnsRenamed({"_key": "_k", "_c1": "_d1", "_c2": "_d2"}), (F.col("_key") == F.col("_k")) & (F.col("_c1") == F.col("_d1")) & (F.col("_c2") == F.col("_d2")), "left")
        return found.select("_key", "_c1", "_c2", "n_words", "sha256", F.when(F.col("_key") > F.col("_rep"), F.when(F.col("n_words") >= self.window, whole)).otherwise(F.col("_spans")).alias("_spans"))


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, gram: int = 16, most: int = 1 << 16) -> Repeats:
    """The passages of df to remove."""
    found = durable(prints(df, key, text, window, gram), "kmer-prints")
    classes = durable(found.filter("_key is not null").groupBy("_c1", "_c2").agg(F.min("_key").alias("_rep")), "kmer-classes")
    least = found.filter(F.size("_minimisers") > 0).select("_c1", "_c2", F.explode("_minimisers").alias("_min"))
    least = least.groupBy("_min").agg(*(f(c).alias(f"_{n}{c}") for c in ("_c1", "_c2") for n, f in (("a", F.min), ("z", F.max))))
    shared = durable(least.filter("_a_c1 <> _z_c1 or _a_c2 <> _z_c2").select("_min"), "kmer-shared")  # likewise for minimisers
    reps = found.filter(F.size("_minimisers") > 0).join(classes, ["_c1", "_c2"]).filter("_key = _rep")
    wanted = reps.select("_key", F.explode("_minimisers").alias("_min")).join(shared, "_min").groupBy("_key").agg(F.collect_set("_min").alias("_wanted"))
    wanted = wanted.join(reps.select(F.col("_key").alias("_k"), "_c1", "_c2").distinct(), F.col("_key") == F.col("_k")).drop("_k")
    texts = df.select(df[key].alias("_id"), df[text].alias("_text")).join(wanted, F.col("_id") == F.col("_key")).drop("_id")

    def own(keys: list, c1: list, c2: list, texts: list, wanted: list) -> dict[str, list]:
        good = [np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words_of(t))), np.int64).tolist() == [a, b] for a, b, t in zip(c1, c2, texts, strict=True)]
        return {c: [x for x, g in zip(v, good, strict=True) if g] for c, v in zip(("_key", "_c1", "_c2", "_text", "_wanted"), (keys, c1, c2, texts, wanted), strict=True)}

    kind = df.schema[key].dataType.simpleString()
    texts = durable(map_columns(texts, ["_key", "_c1", "_c2", "_text", "_wanted"], f"_key {kind}, _c1 long, _c2 long, _text string, _wanted array<long>", own).dropDuplicates(["_key", "_c1", "_c2"]), "kmer-texts")
    strings = durable(_strings(texts, window, gram), "kmers")
    hashed = lambda: (F.xxhash64("_packed").alias("_h"), F.xxhash64(F.lit("second"), "_packed").alias("_g"))
    verdicts, read = _verdicts(strings, window, most)
    verdicts = verdicts.select("_min", *hashed(), "_firsts")
    later = strings.select("_key", "_c1", "_c2", "_at", "_min", *hashed()).join(verdicts, ["_min", "_h", "_g"])
    later = later.filter(F.array_min("_firsts") < F.col("_key"))
    starts = F.filter(F.transform("_firsts", lambda f, i: F.when(f < F.col("_key"), F.col("_at") + i)), lambda x: x.isNotNull())
    later = later.select("_key", "_c1", "_c2", starts.alias("_starts")).groupBy("_key", "_c1", "_c2").agg(F.sort_array(F.flatten(F.collect_list("_starts"))).alias("_starts"))

    def covered(keys: list, c1: list, c2: list, starts: list) -> dict[str, list]:
        return {"_key": keys, "_c1": c1, "_c2": c2, "_spans": [[{"at": a, "to": b} for a, b in merged(s, window)] for s in starts]}

    spans = durable(map_columns(later, ["_key", "_c1", "_c2", "_starts"], f"_key {kind}, _c1 long, _c2 long, _spans array<struct<at:long,to:long>>", covered), "kmer-spans")
    for x in (shared, strings, *read):
        discard(x)
    return Repeats(found, classes, spans, texts.drop("_wanted"), window)


def kept_words(text: str | None, spans: list | None) -> list[bytes]:
    """The words of a text outside of sorted spans."""
    words, out, at = words_of(text), [], 0
    for s in () if spans is None else spans:
        out += words[at : s["at"]]
        at = s["to"]
    return out + words[at:]


def remove(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """df with repeated passages cut out of text: what is left of a text that loses words are its words joined by single spaces. Other texts stay as they are.

    A row travels as one struct, so its columns can have any names.
    """
    found = repeats(df, key, text, **options).removed().filter(F.size("_spans") > 0).select("_key", "_c1", "_c2", "_spans").distinct()

    @F.pandas_udf("struct<a:long,b:long>")
    def cls(texts):
        import pandas as pd

        return pd.DataFrame([np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words_of(t))), np.int64).tolist() for t in texts], columns=["a", "b"])

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        return pd.Series([t if s is None else b" ".join(kept_words(t, s)).decode("utf-8", "surrogatepass") for t, s in zip(texts, spans, strict=True)], dtype="object")

    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("_row"), df[key].alias("_id"), df[text].alias("_text"), cls(df[text]).alias("_c"))
    out = rows.join(found, (F.col("_id") == F.col("_key")) & (F.col("_c.a") == F.col("_c1")) & (F.col("_c.b") == F.col("_c2")), "left").withColumn("_new", cut("_text", "_spans"))
    return out.select(*(F.col("_new").alias(c) if c == text else F.col("_row")[c].alias(c) for c in df.columns))


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, n_words, n_removed and kept_sha256, the SHA-256 of the kept words joined by single spaces, for each row of df.

    Only texts that lose a part of their words are read again.
    """
    found = repeats(df, key, text, **options)
    rows = found.removed()
    part = found.spans.join(found.texts, ["_key", "_c1", "_c2"])

    def hashes(keys: list, c1: list, c2: list, texts: list, spans: list) -> dict[str, list]:
        return {"_k": keys, "_d1": c1, "_d2": c2, "_sha": [hashlib.sha256(b" ".join(kept_words(t, s))).hexdigest() for t, s in zip(texts, spans, strict=True)]}

    kind = df.schema[key].dataType.simpleString()
    shas = map_columns(part, ["_key", "_c1", "_c2", "_text", "_spans"], f"_k {kind}, _d1 long, _d2 long, _sha string", hashes)
    rows = rows.join(shas, (F.col("_key") == F.col("_k")) & (F.col("_c1") == F.col("_d1")) & (F.col("_c2") == F.col("_d2")), "left")
    removed = F.coalesce(F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["at"]), F.lit(0).cast("long"))
    return rows.select(F.col("_key").alias(key), "n_words", removed.alias("n_removed"), F.when(removed == F.col("n_words"), F.lit(NOTHING)).when(removed == 0, F.col("sha256")).otherwise(F.col("_sha")).alias("kept_sha256"))

"""Near duplicates by SimHash, found with an inverted index over the positions of fingerprint bytes.

Fingerprints of 64 bits that differ in at most two bits have at least six of their eight bytes in common, place by place.
The index holds each distinct fingerprint under the six pairs of its four two-byte blocks: of four blocks at most two can differ, so
any linked pair meets under at least one key of four positional bytes. Within a posting, the bytes that two fingerprints share
are tallied, pairs below six are dropped and the rest is verified bit by bit.

A posting of more than `most` fingerprints is split exactly: by two more of its bytes (linked pairs share six), and where that is
still too large by every choice of two of the 16 open bits (linked pairs agree on the others), where a minimum per key links all.
No posting emits its pairs: it emits edges to the first fingerprint of each of its groups, so output grows with the input.

Null and empty texts have no words and the fingerprint zero, which is linked like any other. Repeated texts and rows share a
fingerprint and so a component. An empty table gives an empty result. Texts of any length are read whole. Only the named columns are
read, so further columns can have any names.

`similar` and `keep_one` find near copies by similarity instead: at 0.8 on five-word shingles a tenth of the bits of one fingerprint
differ, which leaves no byte sure to agree. So a document gets a fingerprint of many positions, each the SimHash of the few shingles that
fall there; the index, the tally and the verification work on these in the same manner.
"""

from __future__ import annotations

import itertools

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, durable, map_columns
from .components import components

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the hashes of all shingles; 0 without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return h(b" ".join(words), seed)
    n = len(words) - width + 1
    hashes = np.fromiter((h(s, seed) for s in map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << _BITS[2 * ones > n]).sum(dtype=np.uint64)) if (2 * ones > n).any() else 0


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """key and fp, the fingerprint as a signed long."""

    def rows(keys: list, texts: list) -> dict[str, list]:
        return {key: keys, "fp": [x - (1 << 64) if (x := fingerprint(t, width)) >> 63 else x for t in texts]}

    return map_columns(df, [key, text], f"`{key}` {df.schema[key].dataType.simpleString()}, fp long", rows)


def _bytes_of(fp: str, places: tuple[int, ...]) -> Column:
    """The bytes of fp at these places, and zeros elsewhere."""
    mask = sum(0xFF << 8 * p for p in places)
    return F.col(fp).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def _link(fps: list[int], least_bytes: int, most_bits: int) -> list[tuple[int, int]]:
    """Edges that connect the fingerprints of one posting as all their verified pairs would."""
    x = np.array(sorted(fps), np.int64).view(np.uint64)
    free, edges = np.ones(len(x), bool), []
    for start in range(len(x)):  # searches from each fingerprint that has no group yet; each step tallies a row, not all pairs
        if not free[start]:
            continue
        free[start] = False
        queue = [start]
        while queue:
            i = queue.pop()
            at = np.flatnonzero(free)
            if not len(at):
                break
            differ = x[at] ^ x[i]
            shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)
            kept = at[shared >= least_bytes]
            near = kept[np.bitwise_count(x[kept] ^ x[i]) <= most_bits]
            free[near] = False
            edges += [(int(x[start].view(np.int64)), int(x[j].view(np.int64))) for j in near]
            queue += near.tolist()
    return edges


def _within(postings: DataFrame, most: int, least_bytes: int, most_bits: int) -> tuple[DataFrame, DataFrame]:
    """Edges of the postings (part, bits, fp) of at most `most` rows, and the rows of larger ones with part and bits."""
    sizes = durable(postings.groupBy("part", "bits").agg(F.count("*").alias("n")).filter("n > 1"), "posting-sizes")
    shared = postings.join(sizes, ["part", "bits"])
    small = shared.filter(F.col("n") <= most).groupBy("part", "bits").agg(F.collect_list("fp").alias("fps"))

    def rows(lists: list) -> dict[str, list]:
        found = [e for fps in lists for e in _link(fps, least_bytes, most_bits)]
        return {"x": [a for a, _ in found], "y": [b for _, b in found]}

    return map_columns(small, ["fps"], "x long, y long", rows), shared.filter(F.col("n") > most).select("part", "bits", "fp")


def links(fps: DataFrame, most: int = 256) -> DataFrame:
    """Edges x, y between distinct fingerprints fp that connect whatever pairs of at most two differing bits connect."""
    blocks = [(0, 1), (2, 3), (4, 5), (6, 7)]
    places = [a + b for a, b in itertools.combinations(blocks, 2)]
    keys = F.array(*(F.struct(F.lit(k).alias("part"), _bytes_of("fp", p).alias("bits")) for k, p in enumerate(places)))
    found, large = _within(fps.select("fp", F.explode(keys).alias("k")).select("k.*", "fp"), most, 6, 2)
    large = durable(large, "large-postings")
    if large.isEmpty():
        return found
    # two more bytes: of four open bytes at most two differ
    wider = [(k, q) for k, p in enumerate(places) for q in itertools.combinations([i for i in range(8) if i not in p], 2)]
    more = F.array(*(F.struct(F.lit(n + 6).alias("part"), F.lit(k).alias("of"), _bytes_of("fp", places[k] + q).alias("bits")) for n, (k, q) in enumerate(wider)))
    deeper = large.select("part", "fp", F.explode(more).alias("k")).filter("k.of = part").select("k.part", "k.bits", "fp").distinct()
    found2, largest = _within(deeper, most, 6, 2)
    largest = durable(largest, "large-postings")
    found = found.unionByName(found2)
    if largest.isEmpty():
        return found
    # all choices of two of the 16 open bits: fingerprints that agree on the other 62 are linked through the least of them
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = []
    for n, (k, q) in enumerate(wider):
        bits = [8 * p + i for p in range(8) if p not in places[k] + q for i in range(8)]
        masks += [(n + 6, m, signed((1 << 64) - 1 ^ (1 << i) ^ (1 << j))) for m, (i, j) in enumerate(itertools.combinations(bits, 2))]
    masks = F.broadcast(fps.sparkSession.createDataFrame(masks, "part int, m int, mask long"))  # 4320 rows always
    open_bits = largest.join(masks, "part").select("part", "m", F.expr("fp & mask").alias("rest"), "fp")
    star = open_bits.groupBy("part", "m", "rest").agg(F.min("fp").alias("x"))
    return found.unionByName(open_bits.join(star, ["part", "m", "rest"]).filter("x <> fp").select("x", F.col("fp").alias("y")).distinct())


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, most: int = 256) -> DataFrame:
    """key, fingerprint and component_id, the smallest key that links reach, for each row of df."""
    prints = durable(fingerprints(df, key, text, width), "fingerprints")
    classes = durable(prints.groupBy("fp").agg(F.min(key).alias("least")), "fingerprint-classes")  # copies count once from here on
    pairs = links(classes.select("fp"), most)
    ids = classes.select(F.col("fp"), F.col("least"))
    edges = pairs.join(ids.withColumnsRenamed({"fp": "x", "least": "a"}), "x").join(ids.withColumnsRenamed({"fp": "y", "least": "b"}), "y").select("a", "b")
    found = components(edges)
    named = classes.join(found, classes["least"] == found["node"], "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return prints.join(named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near copies by similarity: positional SimHash over sets of shingles ----

_P, _Q, _R = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S31, _S27, _S30, _ONE = (np.uint64(x) for x in (31, 27, 30, 1))


_WORDS = WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S30)) * _Q
    x = (x ^ (x >> _S27)) * _R
    return x ^ (x >> _S31)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased shingles of `width` words; of all words, if they are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    x, n = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words)), max(1, len(words) - width + 1)
    out = np.full(n, min(len(words), width), np.uint64)
    for k in range(min(width, len(words))):
        out *= _P
        out += x[k : k + n]
    out = _mix(out)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def marks(shingles: np.ndarray, places: int = 24) -> list[tuple[int, list[int]]]:
    """(level, marks) of a set: a SimHash for each of its first `places` places, hashed with level and place.

    At level v, shingles fall into 2**v places by their low bits; v is such that two to four fall into each. A place's SimHash is equal in
    two sets unless one of its few shingles changed. Sets that a fourth more shingles would lift to the next level have
    the marks of that level too, so sets of similarity 0.8 and more, whose sizes differ by a fourth at most, share a level.
    """
    n, out = len(shingles), []
    for level in sorted({max(0, int(np.log2(max(1, m / 2)))) for m in (n, n * 1.25)}) if n else ():
        place = shingles & np.uint64((1 << level) - 1)
        at = np.flatnonzero(place < places)
        place = place[at]
        order = np.argsort(place, kind="stable")
        place, h = place[order], _mix(shingles[at[order]] + _P)
        if not len(h):
            continue
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        size = np.diff(np.r_[first, len(h)])
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits.astype(np.int32), first, axis=0)
        value = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
        own = _mix(_mix(value + _P * (place[first] + _ONE)) + np.uint64(level)).view(np.int64).tolist()
        if n < 12:  # so few places that all can differ; any one shingle in common is enough
            own = sorted({*own, *_mix(shingles + np.uint64(int(_R) * (level + 1) % 2**64)).view(np.int64).tolist()})
        out.append((level, own))
    return out


def _class(shingles: np.ndarray) -> bytes:
    """128 bits for a set, equal for equal sets."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


_SEEDS = _mix(np.arange(1, 129, dtype=np.uint64) * _P)
_ODD = _mix(_SEEDS) | _ONE


def signature(shingles: np.ndarray) -> bytes:
    """128 positional bytes of a set: at each place, a byte of the least of its hashes under the place's own order. Two sets share a byte with about their similarity."""
    least = np.full(len(_SEEDS), np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, ((shingles[at : at + 2048, None] ^ _SEEDS) * _ODD).min(axis=0))
    return (_mix(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def least_bytes(least: float, places: int = 128) -> int:
    """Shared bytes that a pair at similarity `least` has but for one pair in 100,000: the mean less four and a half deviations."""
    return int(np.ceil(places * least - 4.5 * np.sqrt(places * least * (1 - least))))


def _tally(mark: int, members: list[dict], needed: dict[int, int], least: float) -> list[tuple[bytes, bytes]]:
    """Links between the members (cls, component, level, marks, shingles, bytes) of a posting that join different components.

    For each member, the positional bytes that it shares with all later ones are tallied at once; pairs below the least number are dropped. Of the rest,
    pairs that share too few marks go, and pairs that share an earlier mark, which another posting tests. What is left is verified on the whole sets.
    """
    sets = [np.frombuffer(m["shingles"], np.uint64) for m in members]
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")  # partners of a like size are neighbours
    size = size[order]
    members, sets = [members[k] for k in order], [sets[k] for k in order]
    prints = np.frombuffer(b"".join(m["bytes"] for m in members), np.uint8).reshape(len(members), -1)
    marks_of = [frozenset(m["marks"]) for m in members]
    group = np.unique([m["component"].hex() for m in members], return_inverse=True)[1]
    enough, needs, links = least_bytes(least, prints.shape[1]), needed[members[0]["level"]], []
    for i in range(len(members) - 1):
        end = np.searchsorted(size, size[i] / least + 1e-9, side="right")
        j = i + 1 + np.flatnonzero(group[i + 1 : end] != group[i])
        if not len(j):
            continue
        j = j[np.count_nonzero(prints[j] == prints[i], axis=1) >= enough]
        for k in j.tolist():
            both = marks_of[i] & marks_of[k]
            if group[k] != group[i] and len(both) >= needs and min(both) >= mark and similarity(sets[i], sets[k]) >= least:
                links.append((members[i]["cls"], members[k]["cls"]))
                group[group == group[k]] = group[i]
    return links


def similar(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8, places: int = 24, most: int = 2048, most_shingles: int = 1 << 21) -> tuple[DataFrame, DataFrame]:
    """(prints: key and cls of each row of df; components: node (a cls) and component, for classes that are linked to others).

    Rows with equal shingle sets are one class. Classes link at a similarity of `least` and more. The index holds each class under its positional
    marks; within a posting, shared marks are tallied, pairs below the needed number are dropped, and the rest is
    verified on the whole shingle sets, in the posting's task. At a similarity of 0.8 a mark is shared with probability 0.41 to 0.64, so of 24 marks three are
    shared but for one pair in 2000; sets of fewer places need fewer, and those of under 12 shingles have each shingle as a mark too. Each posting first tests its members
    against its least one; only members that this leaves in different components are tallied pair by pair, on 128 positional bytes of their sets (`signature`), in blocks where a
    posting has more than `most` members or `most_shingles` shingles. A block holds each set once.
    """
    kind = df.schema[key].dataType.simpleString()
    needed = {v: 3 if v >= 5 else 2 if v == 4 else 1 for v in range(64)}

    def rows(keys: list, texts: list) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in (key, "cls", "level", "marks")}
        for k, t in zip(keys, texts, strict=True):
            s = shingle_set(t, width)
            for level, m in marks(s, places) or [(0, [])]:
                for c, v in zip(out, (k, _class(s), level, m), strict=True):
                    out[c].append(v)
        return out

    prints = durable(map_columns(df, [key, text], f"`{key}` {kind}, cls binary, level int, marks array<long>", rows), "near-prints")
    classes = prints.groupBy("cls", "level").agg(F.min(key).alias("rep"), F.first("marks").alias("marks")).filter("rep is not null")
    classes = durable(classes, "near-classes")
    index = classes.select("cls", "level", F.explode("marks").alias("mark"))
    heads = index.groupBy("mark").agg(F.min("cls").alias("head"), F.max("cls").alias("_tail"), F.count("*").alias("n")).filter("head <> _tail").drop("_tail")
    postings = durable(index.join(heads, "mark").select("mark", "level", "cls", "head", "n"), "near-postings")
    stars = postings.filter("cls <> head").select("level", F.col("head").alias("a"), F.col("cls").alias("b")).distinct()
    own = lambda c: classes.select("level", F.col("cls").alias(c), F.col("marks").alias(f"_{c}"))
    enough = F.size(F.array_intersect("_a", "_b")) >= F.when(F.col("level") >= 5, 3).when(F.col("level") == 4, 2).otherwise(1)
    edges = _verified(df, classes, stars.join(own("a"), ["level", "a"]).join(own("b"), ["level", "b"]).filter(enough).select("a", "b").distinct(), key, text, width, least)
    found = components(edges)
    # what stars leave open: postings of three and more members in more than one component
    named = postings.filter("n > 2").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed = named.groupBy("mark").agg(F.min("component").alias("_x"), F.max("component").alias("_y")).filter("_x <> _y").select("mark")
    rest = durable(named.join(mixed, "mark"), "near-rest")
    if rest.isEmpty():
        return prints, found
    known = _sets(df, classes, rest, key, text, width)

    def signed(ids: list, sets: list) -> dict[str, list]:
        return {"cls": ids, "shingles": sets, "bytes": [signature(np.frombuffer(x, np.uint64)) for x in sets]}

    full = rest.join(classes.select("cls", "level", "marks"), ["cls", "level"]).join(map_columns(known, ["cls", "shingles"], "cls binary, shingles binary, bytes binary", signed), "cls")
    sums = rest.join(known.select("cls", (F.octet_length("shingles") / 8).alias("_size")), "cls").groupBy("mark").agg(F.ceil(F.greatest(F.count("*") / most, F.sum("_size") / most_shingles)).cast("int").alias("_n"))
    blocks = F.col("_n")
    full = full.join(sums, "mark").withColumn("_b", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    full = full.groupBy("mark", F.least("_b", "_o").alias("_lo"), F.greatest("_b", "_o").alias("_hi")).agg(F.collect_list(F.struct("cls", "component", "level", "marks", "shingles", "bytes")).alias("members"))

    def pairs(keys: list, members: list) -> dict[str, list]:
        got = [x for k, m in zip(keys, members, strict=True) for x in _tally(k, m, needed, least)]
        return {"a": [a for a, _ in got], "b": [b for _, b in got]}

    further = durable(map_columns(full, ["mark", "members"], "a binary, b binary", pairs), "near-links")
    return prints, found if further.isEmpty() else components(edges.unionByName(further))


def _sets(df: DataFrame, classes: DataFrame, wanted: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """cls and shingles of the classes in wanted, from one document of each."""
    reps = classes.join(wanted.select("cls").distinct(), "cls").select("cls", F.col("rep").alias("_rep")).distinct()
    texts = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(reps, F.col("_key") == F.col("_rep")).select("cls", "_text")

    def sets(wanted: list, texts: list) -> dict[str, list]:
        got = [(c, s) for c, t in zip(wanted, texts, strict=True) if _class(s := shingle_set(t, width)) == c]
        return {"cls": [c for c, _ in got], "shingles": [s.tobytes() for _, s in got]}

    return durable(map_columns(texts, ["cls", "_text"], "cls binary, shingles binary", sets).dropDuplicates(["cls"]), "near-sets")


def _verified(df: DataFrame, classes: DataFrame, pairs: DataFrame, key: str, text: str, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of classes whose shingle sets, of one document each, have a similarity of `least` and more."""
    pairs = durable(pairs, "near-pairs")
    known = _sets(df, classes, pairs.select(F.explode(F.array("a", "b")).alias("cls")), key, text, width)
    a, b = (known.select(F.col("cls").alias(c), F.col("shingles").alias(f"_{c}")) for c in "ab")

    def check(a: list, b: list, x: list, y: list) -> dict[str, list]:
        good = [similarity(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)) >= least for s, t in zip(x, y, strict=True)]
        return {"a": [v for v, g in zip(a, good, strict=True) if g], "b": [v for v, g in zip(b, good, strict=True) if g]}

    return durable(map_columns(pairs.join(a, "a").join(b, "b"), ["a", "b", "_a", "_b"], "a binary, b binary", check), "near-links")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8, **options) -> DataFrame:
    """df with one row of each group of near copies: the one with the smallest key.

    Rows without a key and repeated keys are told apart by their shingle sets: of rows with equal key and set one stays, the first by text.
    Rows without a key are never verified against others, so of these equal sets alone are a group, behind rows with a key.
    """
    prints, found = similar(df, key, text, width, least, **options)
    docs = prints.select(key, "cls").distinct()
    named = docs.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("cls"))
    best = named.groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("n"))
    out = durable(named.join(best.filter("n > 1"), "component").filter(order != F.col("best")).select(F.col(key).alias("_other"), F.col("cls").alias("_cls")), "near-others")
    often = prints.groupBy(key, "level").agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(key).isNull()).select(F.col(key).alias("_often")).distinct()
    often = durable(often, "near-often")
    single = df.join(out.select("_other").distinct(), df[key] == out["_other"], "left_anti")
    if often.isEmpty():
        return single
    single = single.join(often, single[key].eqNullSafe(often["_often"]), "left_anti")
    several = df.join(often, df[key].eqNullSafe(often["_often"]), "left_semi")

    @F.pandas_udf("binary")
    def own(texts):
        import pandas as pd

        return pd.Series([_class(shingle_set(t, width)) for t in texts], dtype="object")

    several = several.select(F.struct(*(several[c] for c in df.columns)).alias("_row"), several[key].alias("_k"), several[text].alias("_t"), own(several[text]).alias("_c"))
    several = several.join(out, F.col("_k").eqNullSafe(out["_other"]) & (F.col("_c") == out["_cls"]), "left_anti")
    first = several.groupBy("_k", "_c").agg(F.min_by("_row", F.struct("_t", F.xxhash64("_row"))).alias("_row")).select("_row")
    return single.unionByName(first.select(*(F.col("_row")[c].alias(c) for c in df.columns)))

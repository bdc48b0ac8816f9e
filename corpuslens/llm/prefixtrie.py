"""The prefix trie of conversations, from sorted shards and a skeleton of splitter paths.

A conversation's path is the sequence of its turns, 16 bytes each (the MD5 of role and text); a node of the trie is a distinct beginning of
paths. Paths are cut into shards by splitters, in order of path and conversation, so that equal paths can lie in several
shards. A beginning with conversations on both sides of a splitter is a beginning of the splitter's path, so the trie of the splitter paths, the
skeleton, holds every node that more than one shard has a part of. It is broadcast; its size is bounded by `shards` paths of `deepest`
turns. A shard walks its sorted paths with a stack, as deep as the path at hand, and finishes all nodes but those of the skeleton; of these it
gives partial aggregates, which are reduced by node, and summed up along the skeleton.

The conversation that names a node is known when the node is left, after its children. Children wait for it, `waiting` of them at most in a
task; those of wider nodes and of the skeleton get it by a join. Ids of conversations that end at a node of the skeleton travel as
packed runs in ascending order, one after the other through a hash, so nothing holds them all.

Null roles and texts are empty. Rows without a conversation's id are left out. Turns with one number follow each other by role, then by the MD5;
repeated rows are turns each for itself. Texts of any length count as 16 bytes and a number of words; a conversation's digests are one value
of a row. Only the named columns are read, so others can have any names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_columns

_WIDTH = 16
_ROOT = xxhash.xxh3_128_digest(b"")
_RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SHARD = f"{_RESULT}, kind string, key binary, parent binary, above array<binary>, words long, shard int, run int, ends binary"
_BLANK = r"[\x20\x09-\x0D]+"


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv and turns, an array of (md5, words) in order, for each conversation."""
    r, t = F.coalesce(df[role], F.lit("")), F.coalesce(df[text], F.lit(""))
    digest = F.md5(F.concat(F.char_length(r).cast("string"), F.lit(":"), r, t))
    words = F.size(F.filter(F.split(t, _BLANK), lambda w: w != "")).cast("long")
    rows = df.filter(df[conv].isNotNull()).select(df[conv].alias(conv), F.struct(df[turn].alias("turn"), r.alias("role"), digest.alias("md5"), words.alias("words")).alias("_t"))
    listed = rows.groupBy(conv).agg(F.sort_array(F.collect_list("_t")).alias("_ts"))
    return listed.select(conv, F.transform("_ts", lambda x: F.struct(x["md5"].alias("md5"), x["words"].alias("words"))).alias("turns"))


def with_shared_beginnings(told: DataFrame, conv: str = "conv_id", every: int = 20, most: int = 3) -> DataFrame:
    """told (conv, turns), each conversation c with the first h turns of c - c % every in place of its own first h; h = crc32(c) % (most + 1)."""
    base = told.filter(F.col(conv) % every == 0).select(F.col(conv).alias("_base"), F.slice("turns", 1, most).alias("_head"))
    h = (F.crc32(F.col(conv).cast("string").cast("binary")) % (most + 1)).cast("int")
    own = told.withColumn("_h", h).withColumn("_of", F.col(conv) - F.col(conv) % every).join(base, F.col("_of") == F.col("_base"), "left")
    size = F.size("turns")
    head = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), F.lit(1), F.col("_h"))
    return own.select(conv, F.concat(head, F.slice("turns", F.col("_h") + 1, F.greatest(size - F.col("_h"), F.lit(0)))).alias("turns"))


def _keys(path: bytes) -> list[bytes]:
    """The names of all nodes on a path, the root's first: each is the hash of the one before and a turn."""
    out = [_ROOT]
    for at in range(0, len(path), _WIDTH):
        out.append(xxhash.xxh3_128_digest(out[-1] + path[at : at + _WIDTH]))
    return out


def splitters(paths: DataFrame, shards: int, deepest: int = 64, sampled: int = 20_000) -> list[tuple[bytes, int]]:
    """At most shards - 1 pairs of path and conversation that cut the sorted paths into like parts, from `sampled` conversations at most.

    Those with the least hash of their id are taken, and of their paths the first `deepest` turns, so the driver gets 20 MB at most. Splitters decide
    where a row is worked on, never a result.
    """
    rows = paths.select(F.substring("path", 1, _WIDTH * deepest).alias("path"), "conv", F.xxhash64("conv").alias("_h")).orderBy("_h", "conv").limit(min(sampled, 32 * shards)).collect()
    rows = sorted((bytes(r["path"]), r["conv"]) for r in rows)
    return sorted({rows[len(rows) * k // shards] for k in range(1, shards)}) if rows else []


class _Node:
    __slots__ = ("key", "words", "least", "n", "children", "leaves", "saved", "sha", "skeleton", "wide", "waiting", "ends", "runs")

    def __init__(self, key: bytes, words: int, skeleton: bool):
        self.key, self.words, self.skeleton = key, words, skeleton
        self.least: int | None = None
        self.n = self.children = self.leaves = self.saved = self.runs = 0
        self.sha = hashlib.sha256()
        self.wide = False
        self.waiting: list[tuple] = []
        self.ends: list[int] = []


class _Walk:
    """The walk along one shard's sorted paths; `out` gathers rows of _SHARD as dicts."""

    def __init__(self, shard: int, skeleton: frozenset[bytes], waiting: int, run: int = 4096):
        self.shard, self.skeleton, self.most, self.run = shard, skeleton, waiting, run
        self.stack: list[_Node] = [_Node(_ROOT, 0, True)]
        self.path, self.held, self.out = b"", 0, []

    def add(self, conv: int, path: bytes, words: list[int]) -> None:
        depth = 0
        while depth < len(self.stack) - 1 and path[depth * _WIDTH : (depth + 1) * _WIDTH] == self.path[depth * _WIDTH : (depth + 1) * _WIDTH] != b"":
            depth += 1
        while len(self.stack) - 1 > depth:
            self.close()
        for d in range(depth, len(path) // _WIDTH):
            above = self.stack[-1]
            key = xxhash.xxh3_128_digest(above.key + path[d * _WIDTH : (d + 1) * _WIDTH])
            self.stack.append(_Node(key, words[d], above.skeleton and key in self.skeleton))
        self.path, top = path, self.stack[-1]
        if top.skeleton:
            top.ends.append(conv)
            if len(top.ends) >= self.run:
                self.flush_ends(top)
        else:
            top.sha.update(f",{conv}".encode() if top.n else str(conv).encode())
        top.n += 1
        top.least = conv if top.least is None else min(top.least, conv)

    def flush_ends(self, x: _Node) -> None:
        if x.ends:
            self.out.append({"kind": "ends", "key": x.key, "shard": self.shard, "run": x.runs, "ends": ",".join(map(str, x.ends)).encode()})
            x.runs, x.ends = x.runs + 1, []

    def row(self, kind: str, values: tuple, **more) -> None:
        conv, depth, n, children, leaves, saved, sha = values
        self.out.append({"kind": kind, "conv_id": conv, "depth": depth, "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": sha, **more})

    def let_go(self, x: _Node) -> None:
        """Sends what waits for a node's name to the join."""
        for values, key in x.waiting:
            self.row("open", values, parent=x.key, key=key)
        self.held -= len(x.waiting)
        x.waiting, x.wide = [], True

    def close(self) -> None:
        x = self.stack.pop()
        depth, above = len(self.stack), self.stack[-1] if self.stack else None
        if x.skeleton:
            self.flush_ends(x)
            self.row("part", (x.least, depth, x.n, x.children, x.leaves, x.saved, None), key=x.key, parent=above and above.key, above=[y.key for y in self.stack], words=x.words)
        else:
            x.leaves += not x.children
            x.saved += (x.n - 1) * x.words
            for values, key in x.waiting:
                self.row("done", values, parent_conv_id=x.least, key=key)
            self.held -= len(x.waiting)
            values, key = (x.least, depth, x.n, x.children, x.leaves, x.saved, x.sha.hexdigest()), x.key if x.wide else None
            above.children += 1
            if above.skeleton or above.wide:
                self.row("open", values, parent=above.key, key=key)
            else:
                above.waiting.append((values, key))
                self.held += 1
                if self.held > self.most:
                    for y in self.stack:
                        if y.waiting:
                            self.let_go(y)
        if above:
            above.n += x.n
            above.least = x.least if above.least is None else min(above.least, x.least)
            above.leaves += x.leaves
            above.saved += x.saved

    def end(self) -> None:
        while self.stack:
            self.close()


def _walked(paths: DataFrame, shards: int, deepest: int, waiting: int) -> DataFrame:
    """Rows of _SHARD for paths (conv, path, words)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = paths.sparkSession
    cuts = splitters(paths, shards, deepest)
    held = spark.sparkContext.broadcast((cuts, frozenset(k for p, _ in cuts for k in _keys(p))))

    def dealt(convs: list, found: list, words: list) -> dict[str, list]:
        return {"conv": convs, "path": found, "words": words, "shard": [bisect_right(held.value[0], (p, c)) for p, c in zip(found, convs, strict=True)]}

    rows = map_columns(paths, ["conv", "path", "words"], "conv long, path binary, words array<long>, shard int", dealt)
    rows = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "path", "conv")
    schema = to_arrow_schema(spark.createDataFrame([], _SHARD).schema)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for conv, path, words, shard in zip(*columns, strict=True):
                if walk is None or walk.shard != shard:
                    if walk:
                        walk.end()
                        yield pa.RecordBatch.from_pylist(walk.out, schema=schema)
                    walk = _Walk(shard, held.value[1], waiting)
                walk.add(conv, path, words)
                if len(walk.out) >= 8192:
                    yield pa.RecordBatch.from_pylist(walk.out, schema=schema)
                    walk.out = []
        if walk:
            walk.end()
            yield pa.RecordBatch.from_pylist(walk.out, schema=schema)

    return rows.mapInArrow(job, _SHARD)


def _hashed(ends: DataFrame) -> DataFrame:
    """key and sha: the SHA-256 of the runs (key, shard, run, ends) of each key, in order, joined by commas."""
    schema = "key binary, sha string"

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            for k, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k == key:
                    sha.update(b"," + run)
                    continue
                if key is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], names=["key", "sha"])
                key, sha = k, hashlib.sha256(run)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], names=["key", "sha"])

    return ends.repartition("key").sortWithinPartitions("key", "shard", "run").select("key", "ends").mapInArrow(job, schema)


def trie(told: DataFrame, conv: str = "conv_id", shards: int | None = None, deepest: int = 64, waiting: int = 50_000) -> DataFrame:
    """The nodes of the trie of told (conv, turns), a row each, with the columns of _RESULT.

    conv_id is a node's smallest conversation; parent_conv_id is its parent's. saved_tokens: over all nodes of the subtree, the words of a
    node's last turn once for each conversation but one. ends_sha256: the hash of the ids of conversations that end at the node, joined by commas.
    """
    shards = shards or int(told.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = F.unhex(F.array_join(F.transform("turns", lambda x: x["md5"]), ""))
    paths = durable(told.select(F.col(conv).cast("long").alias("conv"), path.alias("path"), F.transform("turns", lambda x: x["words"]).alias("words")), "trie-paths")
    found = durable(_walked(paths, shards, deepest, waiting), "trie-shards")
    parts = found.filter("kind = 'part'").groupBy("key").agg(
        *(F.first(c).alias(c) for c in ("parent", "above", "words", "depth")), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))
    )
    parts = durable(parts, "trie-skeleton")
    below = parts.filter("parent is not null").groupBy(F.col("parent").alias("_k")).agg(F.count("*").alias("_below"))
    parts = parts.join(below, F.col("key") == F.col("_k"), "left").drop("_k").withColumn("n_children", F.col("n_children") + F.coalesce("_below", F.lit(0)))
    own = parts.select(F.explode(F.concat("above", F.array("key"))).alias("_a"), (F.col("n_children") == 0).cast("long").alias("_leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("_saved"))
    own = own.groupBy("_a").agg(F.sum("_leaf").alias("_leaves"), F.sum("_saved").alias("_saved"))
    names = parts.select(F.col("key").alias("_pk"), F.col("conv_id").alias("_pc"))
    sha = _hashed(found.filter("kind = 'ends'").select("key", "shard", "run", "ends")).withColumnRenamed("key", "_ek")
    whole = parts.join(own, F.col("key") == F.col("_a")).join(names, F.col("parent") == F.col("_pk"), "left").join(sha, F.col("key") == F.col("_ek"), "left")
    whole = whole.select(
        "conv_id", "depth", F.col("_pc").alias("parent_conv_id"), "n_convs", "n_children", (F.col("n_leaves") + F.col("_leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("_saved")).alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
    wide = found.filter("kind in ('done', 'open') and key is not null").select(F.col("key").alias("_pk"), F.col("conv_id").alias("_pc"))
    columns = whole.columns
    late = found.filter("kind = 'open'").join(names.unionByName(wide), F.col("parent") == F.col("_pk")).withColumn("parent_conv_id", F.col("_pc")).select(*columns)
    return whole.unionByName(late).unionByName(found.filter("kind = 'done'").select(*columns))


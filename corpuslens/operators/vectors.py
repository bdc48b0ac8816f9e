"""Vectors: embedding by a provider, exact and approximate search. chunks: repository_id, chunk_id, embedding."""

from __future__ import annotations

import hashlib
import string
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import scalars
from corpuslens.operators import chunking
from corpuslens.sources import files as sources
from corpuslens.sources.durable import durable


class RateLimited(Exception):
    """What a provider raises to be asked again later."""


def hashed_terms(texts: list[str], size: int = 64) -> list[list[float]]:
    """An offline provider: counts of hashed words with signs, scaled to length 1."""
    out = np.zeros((len(texts), size))
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[i, h % size] += 1 if h >> 63 else -1
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


def _embedded(texts: pa.Array, provider: Callable[[list[str]], list[list[float]]], size: int, batch: int, tries: int, wait: float) -> pa.Array:
    """embedding and embed_failed of an Arrow batch; only the texts and vectors of one request are Python objects at a time."""
    out, failed = [pa.array([], pa.list_(pa.float32()))], []
    for at in range(0, len(texts), batch):
        part, pause = texts.slice(at, batch).to_pylist(), wait
        for k in range(tries):
            try:
                got, bad = provider(part), False
                break
            except RateLimited:
                got, bad = [[0.0] * size] * len(part), True
                if k + 1 < tries:
                    time.sleep(pause)
                    pause *= 2
            except Exception:  # noqa: BLE001  a provider may fail in any way; the rows say so
                got, bad = [[0.0] * size] * len(part), True
                break
        out.append(pa.array(got, pa.list_(pa.float32())))
        failed += [bad] * len(part)
    return pa.StructArray.from_arrays([pa.concat_arrays(out), pa.array(failed, pa.bool_())], ["embedding", "embed_failed"])


def embed(df: DataFrame, text: str = "content", provider: Callable[[list[str]], list[list[float]]] = hashed_terms, size: int = 64, batch: int = 100, tries: int = 5, wait: float = 1.0) -> DataFrame:
    """df with embedding and embed_failed. Requests hold up to `batch` texts; a rate limit is waited out with doubling pauses; a request that fails gives zero vectors."""

    @F.arrow_udf("struct<embedding:array<float>,embed_failed:boolean>")
    def vectors(texts: pa.Array) -> pa.Array:
        return _embedded(texts, provider, size, batch, tries, wait)

    return df.withColumn("_v", vectors(F.col(text))).select("*", "_v.*").drop("_v")


def index_repositories(files: DataFrame, path: str, symbols: DataFrame | None = None, provider: Callable[[list[str]], list[list[float]]] = hashed_terms, size: int = 64) -> DataFrame:
    """Cuts all files that aren't binary (is_binary, where there is such a column) into chunks, embeds them, and writes them over the chunks of their repositories; gives repository_id and chunks.

    A repository that has no chunk any more loses those that were written before.
    """
    kept = files.filter(~F.coalesce("is_binary", F.lit(False))) if "is_binary" in files.columns else files
    sources.replace_partitions(embed(chunking.chunk_files(kept, symbols), provider=provider, size=size), path)
    empty = files.select("repository_id").distinct().join(chunking.chunk_files(kept, symbols).select("repository_id").distinct(), "repository_id", "left_anti")
    sources.clear_partitions(empty, path)
    written = files.sparkSession.read.parquet(path).withColumn("repository_id", F.col("repository_id").cast(files.schema["repository_id"].dataType))
    return written.join(files.select("repository_id").distinct(), "repository_id", "left_semi").groupBy("repository_id").agg(F.count("*").alias("chunks"))


def letter_counts(texts: list[str]) -> list[list[float]]:
    """An offline provider that SQL can repeat: how often each letter a to z stands in the text, in either case."""
    return [[float(t.count(c) + t.count(c.upper())) for c in string.ascii_lowercase] for t in (t or "" for t in texts)]


def _cosines(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Cosines of all pairs; 0 for null, empty, unequal lengths, zero vectors and what is no number."""
    out = np.zeros((len(a), len(b)))
    sizes = [np.array([0 if v is None else len(v) for v in side]) for side in (a, b)]
    for n in set(sizes[0].tolist()) - {0}:
        i, j = (np.flatnonzero(s == n) for s in sizes)
        if len(j):
            x, y = (np.array([np.asarray(v, dtype="float64") for v in side.iloc[at]]) for side, at in ((a, i), (b, j)))
            with np.errstate(all="ignore"):
                out[np.ix_(i, j)] = (x @ y.T) / (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :])
    return np.nan_to_num(out, nan=0.0)


def nearest(queries: DataFrame, chunks: DataFrame, k: int = 10, query_rows: int = 2000, chunk_rows: int = 8000, within: tuple[str, ...] = ("repository_id",)) -> DataFrame:
    """query_id, chunk_id, score and rank of the k best chunks for each query, among those with the same columns `within`; ties go to the smaller chunk_id.

    queries: repository_id, query_id, query (a vector). Queries and chunks of a repository are dealt into blocks of about query_rows and
    chunk_rows rows, as many as its row counts ask for. A task takes one block of each, multiplies the matrices and gives k rows a query,
    so no repository needs a task of its own; a query is sent once for each block of chunks, a chunk once for each block of queries.
    """
    blocks = lambda df, rows, name: df.groupBy(*within).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    n = F.broadcast(blocks(queries, query_rows, "_nq").join(blocks(chunks, chunk_rows, "_nc"), list(within)))  # a row for each repository or cell
    dealt = lambda key, own: F.pmod(F.xxhash64(key), F.col(own)).cast("int")
    every = lambda other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))
    own = [F.col(x).alias(f"_{x}") for x in within]
    q = queries.join(n, list(within)).select(*own, "query_id", "query", dealt("query_id", "_nq").alias("_q"), every("_nc").alias("_c"))
    c = chunks.join(n, list(within)).select(*own, "chunk_id", "embedding", dealt("chunk_id", "_nc").alias("_c"), every("_nq").alias("_q"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right, m, found = right.sort_values("chunk_id", kind="stable"), len(right), []
        for at in range(0, len(left) if m else 0, 64):
            part = left.iloc[at : at + 64]
            cosine = _cosines(part["query"], right["embedding"])
            shown = np.floor(np.maximum(0.0, 1 - (1 - cosine)) * 10_000 + 0.5 + 1e-9).astype("int64")  # the score is rounded before it ranks
            order = shown * m + np.arange(m)[::-1]
            top = np.argpartition(order, m - k, axis=1)[:, m - k :] if m > k else np.tile(np.arange(m), (len(part), 1))
            found.append((np.repeat(part["query_id"].to_numpy(object), top.shape[1]), right["chunk_id"].to_numpy(object)[top.ravel()], np.take_along_axis(cosine, top, 1).ravel()))
        ids = [pd.Series(np.concatenate([x[i] for x in found]) if found else [], dtype=object) for i in (0, 1)]
        return pd.DataFrame({"query_id": ids[0], "chunk_id": ids[1], "cosine": np.concatenate([x[2] for x in found]) if found else np.zeros(0)})

    types = [f"{name} {df.schema[name].dataType.simpleString()}" for df, name in ((queries, "query_id"), (chunks, "chunk_id"))]
    by = (*(f"_{x}" for x in within), "_q", "_c")
    near = q.groupBy(*by).cogroup(c.groupBy(*by)).applyInPandas(best, ", ".join([*types, "cosine double"]))
    rows = near.select("query_id", "chunk_id", scalars.score(1 - F.col("cosine")).alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).filter(F.col("rank") <= k)


def ivf_index(chunks: DataFrame, lists: int = 100, sample: int = 20_000, seed: int = 5, rounds: int = 10):
    """(chunks with cell, centres). Centres are fitted on about `sample` vectors; every chunk gets a cell, zero vectors the first."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = chunks.count()
    some = F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    v = chunks.filter(some).withColumn("_v", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    model = KMeans(k=max(1, min(lists, n)), seed=seed, maxIter=rounds, distanceMeasure="cosine", featuresCol="_v", predictionCol="cell").fit(v.sample(min(1.0, sample / max(1, n)), seed))
    return model.transform(v).drop("_v").unionByName(chunks.filter(~some).withColumn("cell", F.lit(0))), [c.tolist() for c in model.clusterCenters()]


def ivf_search(queries: DataFrame, indexed: DataFrame, centres: list[list[float]], k: int = 10, probes: int = 10) -> DataFrame:
    """As nearest, over the `probes` cells whose centres are nearest to a query: blocks of a cell's queries meet blocks of its chunks as matrices."""
    held = pd.Series(centres)

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        order = np.argsort(-_cosines(vectors, held), axis=1, kind="stable")[:, :probes]
        return pd.Series(list(order.astype("int32")), dtype="object")

    return nearest(queries.withColumn("cell", F.explode(cells("query"))), indexed, k, within=("repository_id", "cell"))


def _unit(vectors: pd.Series) -> np.ndarray:
    """Vectors of one length as rows of length one; zero ones stay zero."""
    x = np.array([np.asarray(v, dtype="float64") for v in vectors]) if len(vectors) else np.zeros((0, 0))
    with np.errstate(all="ignore"):
        return np.nan_to_num(x / np.sqrt((x * x).sum(1))[:, None]) if x.size else x


def pq_books(chunks: DataFrame, parts: int = 16, codes: int = 256, most_values: int = 5_000_000, rounds: int = 10, seed: int = 5) -> list[np.ndarray]:
    """For each of `parts` runs of a vector's numbers, up to `codes` centres, by k-means on a sample.

    The sample is those chunks whose id has the least hash, as many as have most_values numbers together (40 MB), so its size and the driver's work are bounded; every chunk gets
    codes. chunks: chunk_id, embedding of one length; null, empty and zero vectors aren't sampled.
    """
    some = chunks.filter(F.exists("embedding", lambda x: x != 0))
    size = some.select(F.max(F.size("embedding"))).first()[0] or 0
    if not size:
        return []
    rows = some.select("embedding", F.xxhash64("chunk_id").alias("_h")).orderBy("_h").limit(max(1, most_values // size)).collect()
    x, rng, books = _unit(pd.Series([r["embedding"] for r in rows])), np.random.default_rng(seed), []
    for run in np.array_split(np.arange(size), min(parts, size)):
        own = x[:, run]
        centres = own[rng.permutation(len(own))[:codes]]
        for _ in range(rounds):
            near = np.argmin((centres * centres).sum(1) - 2 * own @ centres.T, axis=1)
            n = np.bincount(near, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, near, own)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        books.append(centres)
    return books


def pq_index(chunks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """repository_id, chunk_id and codes, a byte for each run of numbers, of every chunk that has a direction."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def coded(vectors: pd.Series) -> pd.Series:
        x, at, out = _unit(vectors), 0, []
        for centres in books:
            own = x[:, at : at + centres.shape[1]]
            out.append(np.argmin((centres * centres).sum(1) - 2 * own @ centres.T, axis=1).astype(np.uint8))
            at += centres.shape[1]
        return pd.Series([r.tobytes() for r in np.stack(out, axis=1)] if len(x) else [], dtype="object")

    some = chunks.filter(F.exists("embedding", lambda x: x != 0))
    return some.select("repository_id", "chunk_id", coded("embedding").alias("codes"))


def pq_candidates(queries: DataFrame, indexed: DataFrame, books: list[np.ndarray], keep: int, query_rows: int = 500, chunk_rows: int = 100_000) -> DataFrame:
    """repository_id, query_id and chunk_id of the `keep` chunks for each query that its tables of distances to the centres put first. Reads codes alone.

    Blocks of queries meet blocks of codes, as in nearest: a repository of any size is many tasks, and each gives `keep` rows a query.
    """
    blocks = lambda df, rows, name: df.groupBy("repository_id").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    n = F.broadcast(blocks(queries, query_rows, "_nq").join(blocks(indexed, chunk_rows, "_nc"), "repository_id"))
    dealt = lambda key, own: F.pmod(F.xxhash64(key), F.col(own)).cast("int")
    every = lambda other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))
    some = queries.filter(F.exists("query", lambda x: x != 0))
    q = some.join(n, "repository_id").select(F.col("repository_id").alias("_r"), "query_id", "query", dealt("query_id", "_nq").alias("_q"), every("_nc").alias("_c"))
    c = indexed.join(n, "repository_id").select(F.col("repository_id").alias("_r"), "chunk_id", "codes", dealt("chunk_id", "_nc").alias("_c"), every("_nq").alias("_q"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right, out = right.sort_values("chunk_id", kind="stable"), []
        ids, code = right["chunk_id"].to_numpy(object), np.frombuffer(b"".join(right["codes"]), np.uint8).reshape(len(right), -1)
        for r, query, v in zip(left["_r"], left["query_id"], _unit(left["query"]), strict=True):
            at, score = 0, np.zeros(len(right))
            for m, centres in enumerate(books):
                score += (centres @ v[at : at + centres.shape[1]])[code[:, m]]
                at += centres.shape[1]
            near = np.flatnonzero(score >= np.partition(score, len(score) - keep)[len(score) - keep]) if len(score) > keep else np.arange(len(score))
            top = near[np.argsort(-score[near], kind="stable")[:keep]]
            out.append(pd.DataFrame({"repository_id": r, "query_id": query, "chunk_id": ids[top], "_near": score[top]}))
        return pd.concat(out) if out else pd.DataFrame({"repository_id": [], "query_id": [], "chunk_id": [], "_near": []})

    kinds = [f"{name} {df.schema[name].dataType.simpleString()}" for df, name in ((queries, "repository_id"), (queries, "query_id"), (indexed, "chunk_id"))]
    by = ("_r", "_q", "_c")
    found = q.groupBy(*by).cogroup(c.groupBy(*by)).applyInPandas(best, ", ".join([*kinds, "_near double"]))
    order = Window.partitionBy("repository_id", "query_id").orderBy(F.desc("_near"), "chunk_id")
    return found.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= keep).select("repository_id", "query_id", "chunk_id")


def pq_search(queries: DataFrame, chunks: DataFrame, indexed: DataFrame, books: list[np.ndarray], k: int = 10, refine: int = 5) -> DataFrame:
    """As nearest, among the k * refine chunks that the codes put first: of these alone the vectors are read, and their exact scores rank.

    Chunks and queries without a direction are in no result.
    """
    return pq_rank(pq_candidates(queries, indexed, books, k * refine), queries, chunks, k)


def pq_rank(near: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """The k best of each query's candidates (repository_id, query_id, chunk_id) by their exact scores."""
    rows = near.join(chunks.select("repository_id", "chunk_id", "embedding"), ["repository_id", "chunk_id"]).join(queries.select("repository_id", "query_id", "query"), ["repository_id", "query_id"])
    rows = rows.select("query_id", "chunk_id", scalars.score(1 - scalars.cosine_similarity(F.col("query"), F.col("embedding"))).alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).filter(F.col("rank") <= k)


def pq_keep(queries: DataFrame, chunks: DataFrame, indexed: DataFrame, books: list[np.ndarray], k: int = 10, refine: int = 5, share: float = 0.93, sample: int = 200) -> int:
    """How many candidates a query needs to find `share` of its k nearest: k * refine at least, half as many more until that holds.

    Codes err by as much whatever the number of chunks, but more chunks come within that error. It is measured against exact search on the `sample` queries
    whose id has the least hash, so this costs a scan of the vectors and a few scans of the codes for a bounded number of queries.
    """
    some = queries.filter(F.exists("query", lambda x: x != 0)).orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    some = durable(some.select("repository_id", "query_id", "query"), "pq-queries")
    exact, keep, most = durable(nearest(some, chunks, k).select("query_id", "chunk_id"), "pq-exact"), k * refine, indexed.count()
    while keep < most:
        found = recall(exact, pq_rank(pq_candidates(some, indexed, books, keep), some, chunks, k)).first()["recall"]
        if found is None or found >= share:
            break
        keep += keep // 2
    return keep


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """The share of exact pairs that were found."""
    hit = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("_hit")), ["query_id", "chunk_id"], "left")
    return hit.agg(F.count("*").alias("pairs"), F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))


def keyword_filter(chunks: DataFrame, word: str, limit: int | None = None) -> DataFrame:
    """Chunks whose content or path contains the word in any case; all, if none does. limit is the caller's page size."""
    hit = chunks.filter(F.contains(F.lower("content"), F.lit(word.lower())) | F.contains(F.lower("path"), F.lit(word.lower())))
    none = hit.limit(1).agg(F.count("*").alias("_n")).filter("_n = 0")
    out = hit.unionByName(chunks.join(F.broadcast(none), how="cross").drop("_n"))  # one row at most
    return out.orderBy("chunk_id").limit(limit) if limit else out

"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all others, with or without a label, are unlabelled text in which a share `prior` is
toxic too. Two linear numpy classifiers, on words with their beginnings and on character runs, are trained by gradient
descent on the non-negative risk: prior times the loss of positives taken as positive, plus the loss of unlabelled text taken as
negative less prior times that of positives taken as negative; where that difference falls below zero, training steps back out of it.
Their mean decides.

Training reads a bounded sample of labelled and unlabelled documents (most_positive, most_unlabelled) with the features that tell them apart best; the prior is counted
over all labels. Every document is scored over its whole text. Null and empty texts get the score of a text without words. Repeated
rows get equal scores; repeated labels of a document count once, as toxic if any says so. Without a positive label, the score is the prior;
so it is without training documents. An empty table gives an empty result. Features that tell classes apart equally well are taken in
their own order. Labels, ids and sources never are features; only the named columns are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, map_columns
from .decontaminate import tokens

VIEWS = ("words", "runs")


def features(word: bytes, view: str) -> list[bytes]:
    """Of a lower-cased word: itself with a mark at the end and its first 3 to 5 bytes, or its runs of 4 bytes with a mark at the start."""
    if view == "words":
        return [word + b"$", *(word[:k] for k in (3, 4, 5) if len(word) > k)]
    x = b"^" + word
    return [x[i : i + 4] for i in range(max(1, len(x) - 3))]


def counts(text: str | None) -> tuple[list[bytes], np.ndarray]:
    """The distinct words and their damped counts, scaled to length 1 together, so texts of any length compare."""
    c = Counter(tokens(text))
    value = 1 + np.log(np.fromiter(c.values(), float, len(c)))
    return list(c), value / max(np.sqrt((value**2).sum()), 1e-9)


def vector(text: str | None, numbers: dict[bytes, int], view: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the text's features that have a number."""
    got: dict[int, float] = {}
    for w, v in zip(*counts(text), strict=True):
        for f in features(w, view):
            if (i := numbers.get(f)) is not None:
                got[i] = got.get(i, 0.0) + v
    return np.fromiter(got, np.int64, len(got)), np.fromiter(got.values(), float, len(got))


class Rows:
    """Sparse rows: how many features each has, and all their numbers and values."""

    def __init__(self, sizes: np.ndarray, col: np.ndarray, val: np.ndarray):
        self.sizes, self.col, self.val = np.asarray(sizes, np.int64), np.asarray(col, np.int32), np.asarray(val, np.float32)

    def __len__(self) -> int:
        return len(self.sizes)


class _Sums:
    """Sums of values by a group that each has, over groups in order."""

    def __init__(self, group: np.ndarray, size: int):
        self.order, self.size = np.argsort(group, kind="stable"), size
        self.groups, self.first = np.unique(group[self.order], return_index=True)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size, np.float32)
        if len(self.first):
            out[self.groups] = np.add.reduceat(values, self.first)
        return out


class Linear:
    """A linear classifier on numbered features, with the non-negative risk. Values are multiplied by `scale`."""

    def __init__(self, size: int, scale: float = 10.0):
        self.w, self.b, self.scale = np.zeros(size), 0.0, scale

    @staticmethod
    def _sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    def fit(self, positive: Rows, unlabelled: Rows, prior: float, rounds: int = 300, rate: float = 0.2, ridge: float = 1e-5, settled: float = 1e-4) -> Linear:
        """Adam over full batches, with the logistic loss, until the risk has fallen by less than `settled` of itself in 20 rounds."""
        p, n = len(positive), len(positive) + len(unlabelled)
        rows = Rows(*(np.concatenate([getattr(positive, k), getattr(unlabelled, k)]) for k in ("sizes", "col", "val")))
        row, size = np.repeat(np.arange(n, dtype=np.int32), rows.sizes), len(self.w)
        val = (rows.val * self.scale).astype(np.float32)
        by_row, by_col = _Sums(row, n), _Sums(rows.col, size)
        order = by_col.order
        row_c, val_c = row[order], val[order]
        w, b = self.w.astype(np.float32), float(np.log(prior / (1 - prior)))
        m, s = np.zeros(size + 1), np.zeros(size + 1)
        self.risks: list[float] = []
        for t in range(1, rounds + 1):
            z = by_row(val * w[rows.col]) + b
            q = self._sigmoid(z)
            negative = np.logaddexp(0, z[p:]).mean() - prior * np.logaddexp(0, z[:p]).mean()
            self.risks.append(float(prior * np.logaddexp(0, -z[:p]).mean() + max(0.0, negative)))
            gz = np.zeros(n, np.float32)
            if negative >= 0:
                gz[:p] = -prior / p  # of prior * (loss as positive - loss as negative)
                gz[p:] = q[p:] / (n - p)
            else:
                gz[:p] = prior * q[:p] / p
                gz[p:] = -q[p:] / (n - p)
            g = np.append(by_col(val_c * gz[row_c]) + ridge * w, gz.sum(dtype=float))
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8) / np.sqrt(1 + t / 20)
            w, b = w - step[:-1].astype(np.float32), b - step[-1]
            if t > 40 and min(self.risks[-20:]) > (1 - settled) * min(self.risks[:-20]):
                break
        self.w, self.b = w.astype(float), float(b)
        return self


class Model(dict):
    """Scores texts. It remembers each word's weights by view (None where all are zero), up to `most` words."""

    def __init__(self, numbers: tuple[dict[bytes, int], ...], parts: tuple[Linear, ...], prior: float, most: int = 300_000):
        self.numbers, self.parts, self.prior, self.most = numbers, parts, prior, most
        self.weights = [{f: p.scale * float(p.w[i]) for f, i in n.items()} for n, p in zip(numbers, parts, strict=True)]

    def __reduce__(self):
        return Model, (self.numbers, self.parts, self.prior, self.most)

    def __missing__(self, word: bytes) -> tuple[float, ...] | None:
        if len(self) >= self.most:
            self.clear()
        sums = tuple(sum(known[f] for f in features(word, v) if f in known) for v, known in zip(VIEWS, self.weights, strict=True))
        got = self[word] = sums if any(sums) else None
        return got

    def score(self, text: str | None) -> float:
        if not self.parts:
            return self.prior
        words, value = counts(text)
        told = [(i, x) for i, x in enumerate(map(self.__getitem__, words)) if x is not None]
        z = [p.b + sum(value[i] * x[v] for i, x in told) for v, p in enumerate(self.parts)]
        return float(Linear._sigmoid(np.array(z)).mean())


def telling(sample: DataFrame, most_features: int) -> tuple[dict[bytes, int], ...]:
    """By view, numbers of the features whose shares among positives (_y 1) and unlabelled texts (_y 0) differ most beyond chance."""

    def tally(texts: list, ys: list) -> dict[str, list]:
        sums = [[Counter(), Counter()] for _ in VIEWS]
        for t, y in zip(texts, ys, strict=True):
            words = set(tokens(t))
            for view, by_class in zip(VIEWS, sums, strict=True):
                by_class[1 - y].update({f for w in words for f in features(w, view)})
        rows = [(v, f, p[f], u[f]) for v, (p, u) in enumerate(sums) for f in p.keys() | u.keys()]
        return {c: [r[i] for r in rows] for i, c in enumerate(("view", "feature", "p", "u"))}

    n = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    found = map_columns(sample, ["_text", "_y"], "view int, feature binary, p long, u long", tally).groupBy("view", "feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    both = (F.col("p") + F.col("u")) / (n[0] + n[1])
    gap = (F.col("p") / n[1] - F.col("u") / n[0]) / F.sqrt(both * (1 - both) * (1 / n[1] + 1 / n[0]) + 1e-9)
    told = found.filter("p + u >= 3").withColumn("z", F.abs(gap)).filter("z > 5")
    best = lambda v: told.filter(F.col("view") == v).orderBy(F.desc("z"), "feature").limit(most_features).collect()
    return tuple({bytes(r["feature"]): i for i, r in enumerate(best(v))} for v in range(len(VIEWS)))


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", prior: float | None = None,
    most_positive: int = 3000, most_unlabelled: int = 6000, most_features: int = 3000, seed: int = 11, **fit,
) -> Model:
    """docs and labels hold training rows alone. The sample is drawn by a hash of the key, so it is the same in every run.

    Unlabelled text is a draw of all training documents, so the prior holds for it. The driver gets the sample's values of at most
    most_features features a view.
    """
    told = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_y"))
    n = told.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("_y") == 1, 1)), F.lit(0)).alias("p")).first()
    if not n["p"]:
        return Model((), (), prior if prior is not None else 0.0)
    prior = min(0.9, max(1e-3, prior if prior is not None else n["p"] / n["n"]))
    total = docs.count()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    positive = rows.join(told.filter("_y = 1").select(F.col(key).alias("_key")), "_key", "left_semi").filter(drawn(seed, most_positive / n["p"], "_key", "_text"))
    unlabelled = rows.filter(drawn(seed + 1, most_unlabelled / max(1, total), "_key", "_text"))
    # equal texts count once, so a text of which there are very many can't fill the sample
    parts = [x.select("_text").distinct().withColumn("_y", F.lit(y)) for x, y in ((positive, 1), (unlabelled, 0))]
    sample = durable(parts[0].unionByName(parts[1]).repartition(docs.sparkSession.sparkContext.defaultParallelism), "toxic-sample")
    if sample.select("_y").distinct().count() < 2:
        return Model((), (), prior)
    numbers = telling(sample, most_features)

    def vectors(texts: list, ys: list) -> dict[str, list]:
        out: dict[str, list] = {"y": ys}
        for v, view in enumerate(VIEWS):
            got = [vector(t, numbers[v], view) for t in texts]
            out |= {f"i{v}": [i for i, _ in got], f"v{v}": [x for _, x in got]}
        return out

    found = map_columns(sample, ["_text", "_y"], "y int, i0 array<int>, v0 array<float>, i1 array<int>, v1 array<float>", vectors).toArrow()

    def side(view: int, y: int) -> Rows:
        part = found.filter(pc.equal(found["y"], y)).combine_chunks()
        col, val = part[f"i{view}"], part[f"v{view}"]
        return Rows(pc.list_value_length(col).to_numpy(), pc.list_flatten(col).to_numpy(), pc.list_flatten(val).to_numpy())

    return Model(numbers, tuple(Linear(len(numbers[v])).fit(side(v, 1), side(v, 0), prior, **fit) for v in range(len(VIEWS))), prior)


def drawn(seed: int, share: float, *columns: str) -> Column:
    """True for this share of all rows, by a hash of these columns; a share of 2**-50 is still exact."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 1) < int(min(1.0, share) * (2**63 - 1024))


def held_out(key: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(folds)) == 0


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score and predicted for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most most_features weights a view, whatever the corpus

    def rows(keys: list, texts: list) -> dict[str, list]:
        scores = [shared.value.score(t) for t in texts]
        return {key: keys, "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    return map_columns(docs, [key, text], f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, predicted int", rows)

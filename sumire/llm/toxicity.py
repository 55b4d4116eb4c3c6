"""Toxicity by a chain of linear classifiers trained with out-of-fold predictions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import fresh, table
from .decontaminate import WORDS

#: Labelled rows that the chain is fitted on at most, those of the lowest hash of doc_id; scoring covers all rows.
SAMPLE = 4000
#: Bytes of the sample's distinct words that the driver holds at most; rows beyond it are left out of the sample.
SAMPLE_BYTES = 64 << 20
#: Features of a model at most, the documents that must have one, its least log-likelihood ratio (G) and size of log odds.
FEATURES, SUPPORT, LEAST_G, LEAST_ODDS = 300, 3, 22.0, 2.0
FOLDS, RIDGE, HALF = 5, 0.1, 0.5
DENSE = 4


def parts_of(text: bytes | None) -> tuple[set[bytes], list[float]]:
    """A text's distinct words, their beginnings of 4 and 5 bytes (tagged), and its dense features."""
    raw = text or b""
    words = raw.translate(WORDS).split()
    own = set(words)
    found = own | {b"4 " + w[:4] for w in own} | {b"5 " + w[:5] for w in own}
    n, size = max(len(words), 1), max(len(raw), 1)
    return found, [np.log1p(len(words)) / 10, len(own) / n, sum(map(len, words)) / size, min(size / n, 40) / 40]


@dataclass
class Link:
    """One category's model: its own features, the dense ones and the probabilities of the categories before it."""

    name: str
    at: dict[bytes, int]
    weights: np.ndarray  # features, dense, earlier categories, bias

    def score(self, found: set[bytes], dense: list[float], before: list[float]) -> float:
        w, k = self.weights, len(self.at)
        z = w[-1] + sum(w[self.at[x]] for x in found & self.at.keys()) + float(np.dot(w[k:-1], [*dense, *before]))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _chosen(rows: list[set[bytes]], y: np.ndarray) -> dict[bytes, int]:
    yes, no = Counter(), Counter()
    for found, label in zip(rows, y, strict=True):
        (yes if label else no).update(found)
    p, n, scored = int(y.sum()), int(len(y) - y.sum()), []
    for x in {*yes, *no}:
        a, b = yes[x], no[x]
        if a + b >= SUPPORT:
            odds = np.log((a + 0.5) / (p - a + 0.5)) - np.log((b + 0.5) / (n - b + 0.5))
            if abs(odds) >= LEAST_ODDS:
                share = (a + b) / (p + n)
                g = 2 * sum(k * np.log(k / e) for k, e in ((a, p * share), (b, n * share), (p - a, p * (1 - share)), (n - b, n * (1 - share))) if k)
                if g >= LEAST_G:
                    scored.append((-g, x))
    return {x: i for i, (_, x) in enumerate(sorted(scored)[:FEATURES])}


def _matrix(rows: list[set[bytes]], dense: np.ndarray, at: dict[bytes, int], before: np.ndarray) -> np.ndarray:
    x = np.zeros((len(rows), len(at)))
    for i, found in enumerate(rows):
        x[i, [at[f] for f in found & at.keys()]] = 1
    return np.hstack([x, dense, before, np.ones((len(rows), 1))])


def _newton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression, its bias free."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_chain(rows: list[set[bytes]], dense: np.ndarray, labels: dict[str, np.ndarray]) -> list[Link]:
    """A link for each category in order. What a later link learns from an earlier one are its out-of-fold probabilities.

    A category of one class alone gets no feature and its smoothed share as a constant.
    """
    fold = np.arange(len(rows)) % FOLDS
    before, chain = np.zeros((len(rows), 0)), []
    for name, y in labels.items():
        if not len(y) or y.min() == y.max():
            share = (y.sum() + 0.01) / (len(y) + 1) if len(y) else 0.01
            w = np.zeros(dense.shape[1] + before.shape[1] + 1)
            w[-1] = np.log(share / (1 - share))
            chain.append(Link(name, {}, w))
            out = np.full(len(rows), share)
        else:
            out = np.zeros(len(rows))
            for k in range(FOLDS):
                inside = fold != k
                some = [r for r, i in zip(rows, inside, strict=True) if i]
                if not y[inside].any() or y[inside].all():
                    out[~inside] = y[inside].mean()
                    continue
                at = _chosen(some, y[inside])
                w = _newton(_matrix(some, dense[inside], at, before[inside]), y[inside])
                rest = _matrix([r for r, i in zip(rows, inside, strict=True) if not i], dense[~inside], at, before[~inside])
                out[~inside] = 1 / (1 + np.exp(-np.clip(rest @ w, -500, 500)))
            at = _chosen(rows, y)
            chain.append(Link(name, at, _newton(_matrix(rows, dense, at, before), y)))
        before = np.hstack([before, out[:, None]])
    return chain


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Link]:
    """The chain low_quality, toxic, fitted on at most sample labelled rows.

    Labels with a null are left out; of several rows for a doc_id the worst values count. Only the sample's
    distinct words reach the driver, SAMPLE_BYTES of them at most.
    """
    rows = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("__label_id")).agg(F.min("quality").alias("__quality"), F.max("toxic").alias("__toxic"))
    few = rows.orderBy(F.xxhash64("__label_id"), "__label_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.col("text").cast("binary").alias("__text")).join(F.broadcast(few), F.col("__doc") == F.col("__label_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parts_of(x) for x in b.column(1).to_pylist()]
            words = [b" ".join(sorted(x for x in f if b" " not in x)) for f, _ in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary()), pa.array([d for _, d in found], pa.list_(pa.float64())), b.column(2), b.column(3)], ["id", "words", "dense", "quality", "toxic"])

    seen = texts.select("__doc", "__text", F.col("__quality").cast("int"), F.col("__toxic").cast("int")).mapInArrow(run, "id long, words binary, dense array<double>, quality int, toxic int")
    held, size = {}, 0
    for r in seen.orderBy(F.xxhash64("id"), "id", "words").toLocalIterator():
        if size + len(r.words) <= SAMPLE_BYTES:  # a row that doesn't fit is passed over
            held[r.id] = r
            size += len(r.words)
    seen = list(held.values())
    rows_ = [(lambda own: own | {b"4 " + w[:4] for w in own} | {b"5 " + w[:5] for w in own})(set(bytes(r["words"]).split())) for r in seen]
    dense = np.array([r["dense"] for r in seen]).reshape(len(seen), DENSE)
    return fit_chain(rows_, dense, {"low_quality": np.array([float(r["quality"] == 0) for r in seen]), "toxic": np.array([float(r["toxic"] > 0) for r in seen])})


def score(docs: DataFrame, chain: list[Link]) -> DataFrame:
    """docs and, as its last column, __p (named otherwise if docs has one): the probability of each category in the chain's order.

    Null and empty texts are scored by what they lack.
    """
    at, held, (name,) = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(chain), fresh(docs, "__p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = held.value
        for b in batches:
            out = []
            for x in b.column(at).cast(pa.binary()).to_pylist():
                found, dense = parts_of(x)
                p: list[float] = []
                for link in links:
                    p.append(link.score(found, dense, p))
                out.append(p)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and toxic (p_toxic of a half or more) of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.col("__p")[0].alias("p_low_quality"), F.col("__p")[1].alias("p_toxic"), (F.col("__p")[1] >= HALF).alias("toxic"))


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't toxic."""
    chain = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, chain)
    return out.where(F.col(out.columns[-1])[1] < HALF).drop(out.columns[-1])

"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models over the words that a text holds; each model also sees the
probabilities of the categories before it, and is trained with out-of-fold ones, as those it will see are not its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnframe.llm.common import batches, materialize

#: The chain: name and SQL over the columns of labels. The last decides.
CHAIN = (("low_quality", "cast(quality = 0 as int)"), ("severe", "cast(toxic = 1 and quality = 0 as int)"), ("toxic", "toxic"))
#: Bounds of what is fitted: labelled rows (those of the least hash of doc_id), and words.
SAMPLE_ROWS = 16000
VOCABULARY = 384
MIN_DOCUMENTS = 6
FOLDS = 5
RIDGE = 2.0
STEPS = 150
_WORD = re.compile(r"\w+")


def words_of(text: bytes | None) -> set[str]:
    return set(_WORD.findall((text or b"").decode("utf-8", "replace").lower()))


@dataclass
class Link:
    """One model of the chain: weights of the words, then of the logits of earlier categories, then the constant."""

    name: str
    weights: np.ndarray
    threshold: float


@dataclass
class Chain:
    vocabulary: dict[str, int]
    links: list[Link]

    def probabilities(self, present: np.ndarray) -> np.ndarray:
        """Rows of 0/1 words -> rows of one probability a category."""
        x, out = np.hstack([present, np.ones((len(present), 1))]), []
        for link in self.links:
            p = _sigmoid(x @ link.weights)
            out.append(p)
            x = np.hstack([x, _logit(p)[:, None]])
        return np.stack(out, 1)

    def present(self, texts: list[bytes | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.vocabulary)))
        for i, t in enumerate(texts):
            for w in words_of(t) & self.vocabulary.keys():
                x[i, self.vocabulary[w]] = 1
        return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient steps; the step is the inverse of a bound on the curvature."""
    y = y.astype(x.dtype)
    w = v = np.zeros(x.shape[1], x.dtype)
    u = np.ones(x.shape[1], x.dtype)
    for _ in range(20):  # power iteration: largest eigenvalue of x'x
        u = x.T @ (x @ u)
        u /= np.linalg.norm(u) or 1
    rate = 1 / (0.25 * 1.05 * np.linalg.norm(x.T @ (x @ u)) + RIDGE)
    for k in range(STEPS):
        new = v - rate * (x.T @ (_sigmoid(x @ v) - y) + RIDGE * v)
        w, v = new, new + k / (k + 3) * (new - w)
    return w


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability at which F1 is best out of fold, of those at which at least half of what is rejected has the mark; else 0.5.

    With few marked rows nothing may be learnt, and F1 alone is then best where nearly all is rejected.
    """
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = 0  # equal probabilities stand or fall together
    f1[2 * hits < np.arange(1, len(y) + 1)] = 0
    if not f1.any():
        return 0.5
    k = int(np.argmax(f1))
    return float((p[order][k] + (p[order][k + 1] if k + 1 < len(p) else 0)) / 2)


def fit_chain(vocabulary: dict[str, int], present: np.ndarray, labels: np.ndarray, folds: np.ndarray, names: list[str]) -> Chain:
    """The chain over rows of 0/1 words and rows of 0/1 labels."""
    x = np.hstack([present, np.ones((len(present), 1), np.float32)])
    links = []
    for c, name in enumerate(names):
        y, held = labels[:, c].astype(float), np.zeros(len(x))
        for k in range(FOLDS):
            out = folds == k
            if out.any():
                held[out] = _sigmoid(x[out] @ _fit(x[~out], y[~out])) if (~out).any() else 0.5
        links.append(Link(name, _fit(x, y), _threshold(held, y)))
        x = np.hstack([x, _logit(held)[:, None].astype(np.float32)])
    return Chain(vocabulary, links)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Chain | None:
    """A chain fitted on at most SAMPLE_ROWS labelled documents; None if there are none.

    Words are chosen in Spark by their chi-square with any category. To the driver come at most SAMPLE_ROWS rows of
    indices of at most VOCABULARY words.
    """
    names = [n for n, _ in CHAIN]
    marks = labels.select("doc_id", *[F.expr(e).cast("int").alias(n) for n, e in CHAIN]).dropna().groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    some = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    sample = materialize(spark, docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"]), "toxicity")
    size = sample.agg(F.count("*"), *[F.sum(n) for n in names]).first()
    if not size[0]:
        return None

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), *[(n, pa.int32()) for n in names]])
        for b in it:
            rows = zip(b.column("text"), *(b.column(n).to_pylist() for n in names))
            yield from batches(((w, *marks) for t, *marks in rows for w in words_of(t.as_py())), schema)

    n = float(size[0])
    met = sample.mapInArrow(spread, "word string, " + ", ".join(f"{c} int" for c in names)).groupBy("word").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names]).where(f"n >= {MIN_DOCUMENTS}")
    chi = [F.try_divide(F.pow(F.col(c) - F.col("n") * (size[i + 1] / n), F.lit(2.0)), F.col("n") * (size[i + 1] / n) * (1 - size[i + 1] / n)) for i, c in enumerate(names)]
    best = met.select("word", F.greatest(*[F.coalesce(x, F.lit(0.0)) for x in chi], F.lit(0.0)).alias("chi")).orderBy(F.desc("chi"), "word").limit(VOCABULARY).collect()
    vocabulary = {r["word"]: i for i, r in enumerate(best)}

    def index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [sorted(vocabulary[w] for w in words_of(t.as_py()) & vocabulary.keys()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(c) for c in names), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", *names, "at"])

    rows = sample.mapInArrow(index, "doc_id long, " + ", ".join(f"{c} int" for c in names) + ", at array<int>").orderBy("doc_id").collect()
    present = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, r in enumerate(rows):
        present[i, r["at"]] = 1
    folds = np.array([(r["doc_id"] * 2654435761 >> 7) % FOLDS for r in rows])
    return fit_chain(vocabulary, present, np.array([[r[c] for c in names] for r in rows]), folds, names)


def score(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """doc_id, p_<category> of each category of the chain, and toxic: whether the last is at its threshold or above."""
    names = [n for n, _ in CHAIN]
    schema = pa.schema([("doc_id", pa.int64()), *[(f"p_{n}", pa.float64()) for n in names], ("toxic", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                p = chain.probabilities(chain.present([t.as_py() for t in part.column("text")])) if chain else np.zeros((part.num_rows, len(names)))
                toxic = p[:, -1] >= chain.links[-1].threshold if chain else np.zeros(part.num_rows, bool)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.round(p[:, i], 6)) for i in range(len(names))), pa.array(toxic)], schema=schema)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"p_{n} double" for n in names) + ", toxic boolean")


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Probabilities and verdict of every document, by a chain trained on labels.

    Labels that are null in any category, or of no document, train nothing; repeated labels count once, by their maximum.
    Without any usable label every probability is 0 and nothing is toxic. A null or empty text has no words and gets what
    the constants say. Repeated rows are scored alike; no rows give no rows.
    """
    return score(docs, train(spark, docs, labels))


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, with all columns, without those that the chain rejects. The verdict is made beside the row, without a join."""
    chain = train(spark, docs, labels)
    if not chain:
        return docs

    @F.pandas_udf("boolean")
    def toxic(texts):
        import pandas as pd

        return pd.Series([bool(p >= chain.links[-1].threshold) for at in range(0, len(texts), 1000) for p in chain.probabilities(chain.present([t if t is None else bytes(t) for t in texts[at : at + 1000]]))[:, -1]], dtype=bool)

    return docs.where(~toxic(F.col("text").cast("binary")))

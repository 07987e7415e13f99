"""Quality classifier: regularised quadratic discriminant on document statistics.

Each whole text gives a vector of bounded statistics (shares and logarithms). Each class
has a mean and a covariance, shrunk towards the pooled covariance and then towards a
multiple of the identity (Friedman, 1989). The score is the logistic function of the
difference of log densities and log priors; densities come from Mahalanobis distances by
Cholesky factors that are computed once and cached in the model.

Moments are sums over labelled training rows, added up in Spark; the driver only gets two
vectors and two matrices of FEATURES' size. The model is fitted on TRAIN labels at most (all of
them up to that number, else those of the smallest hashes of doc_id), which is ample for
two classes of 16 statistics; so only their texts are read twice, and all texts are scored in
one pass where they are read.

Edge cases: a null or empty text has the statistics of no words and gets a score like any
other; rows without a label, or with a null one, train nothing; a document with two labels
counts with each; with fewer than two training rows of either class the score is the share
of good rows (0.5 without any); texts of any length are read whole; repeated rows score alike;
extra columns are ignored, or kept by ``keep_good``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bound_batches, crc_mod, materialize, release_memory

FEATURES = [
    "log_words", "word_length", "upper", "digit", "comma_stop", "exclaim", "pipe", "symbol", "space",
    "no_letter_words", "signed_words", "upper_words", "distinct", "repeated_lines", "words_a_line", "short_words",
]
THRESHOLD = 0.7
#: Labels that the model is fitted on at most.
TRAIN = 50_000
#: Share of the pooled covariance, and then of the identity.
POOLED, IDENTITY = 0.6, 0.02

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#$%&*@<>{}[]\\^~=+_/"
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_ENDS = tuple("#$%&*!|@<>{}[]\\^~=+_/")


def statistics(text: str | None) -> list[float]:
    """FEATURES of one whole text."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    words, n = text.split(), len(data)
    k = len(words)
    if not k:
        return [0.0] * len(FEATURES)

    def share(chars: bytes) -> float:
        return (n - len(data.translate(None, chars))) / n

    lines = [x for x in text.split("\n") if x.strip()]
    no_letter = sum(not w.strip("#$%&*!|@<>{}[]\\^~=+_/.,;:-0123456789") for w in words)
    signed = sum(w.endswith(_ENDS) for w in words)
    upper = sum(map(str.isupper, words))
    long_lines = [x for x in lines if len(x) > 20]
    return [
        math.log10(1 + k) / 5,
        min(sum(map(len, words)) / k, 20) / 10,
        math.sqrt(share(_UPPER)),
        math.sqrt(share(_DIGITS)),
        math.sqrt(data.count(b",") / n + data.count(b".") / n),
        math.sqrt(data.count(b"!") / n),
        math.sqrt(data.count(b"|") / n),
        math.sqrt(share(_SYMBOLS)),
        share(b" \n\t\r"),
        math.sqrt(no_letter / k),
        math.sqrt(signed / k),
        math.sqrt(upper / k),
        len(set(words)) / k * math.log10(1 + k) / 5,
        1 - len(set(long_lines)) / len(long_lines) if long_lines else 0.0,
        math.log10(1 + k / max(len(lines), 1)) / 4,
        sum(len(w) < 4 for w in words) / k,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)``: the statistics of every row."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    means: np.ndarray
    factors: np.ndarray
    logs: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x``."""
        if not len(self.means):
            return np.full(len(x), self.prior)
        density = []
        for mean, factor, log in zip(self.means, self.factors, self.logs):
            z = (x - mean) @ factor.T
            density.append(log - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -700, 700)))


def _moments(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Counts, sums and sums of products of each class, of blocks of statistics and labels."""
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for x, y in blocks:
        for c in (0, 1):
            own = x[y == c]
            total[c] += np.r_[len(own), own.sum(axis=0), (own.T @ own).ravel()]
    label = np.repeat([0, 1], total.shape[1])
    at = np.tile(np.arange(total.shape[1]), 2)
    return pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(at, pa.int32()), pa.array(total.ravel())], ["label", "at", "v"])


#: What ``_moments`` gives.
MOMENTS = "label int, at int, v double"


def fit(rows: DataFrame, pooled: float = POOLED, identity: float = IDENTITY) -> Model:
    """Model from ``rows(x, label)`` with label 0 or 1: all of them, by sums in Spark."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _moments((b.column("x").flatten().to_numpy().reshape(-1, len(FEATURES)), b.column("label").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows)

    return _model(rows.select("x", "label").mapInArrow(sums, MOMENTS), pooled, identity)


def _model(parts: DataFrame, pooled: float = POOLED, identity: float = IDENTITY) -> Model:
    """Model from the moments of all parts of the rows."""
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for label, at, v in parts.groupBy("label", "at").agg(F.sum("v")).collect():
        total[label, at] = v
    n = total[:, 0]
    if n.min() < 2:
        return Model(np.zeros((0, d)), np.zeros((0, d, d)), np.zeros(0), float(n[1] / n.sum()) if n.sum() else 0.5)
    means = total[:, 1 : 1 + d] / n[:, None]
    scatter = total[:, 1 + d :].reshape(2, d, d) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    common = scatter.sum(axis=0) / n.sum()
    factors, logs = [], []
    for c in (0, 1):
        cov = (1 - pooled) * scatter[c] / n[c] + pooled * common
        cov = (1 - identity) * cov + identity * np.trace(cov) / d * np.eye(d) + 1e-9 * np.eye(d)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        logs.append(math.log(n[c] / n.sum()) - np.log(np.diag(low)).sum())
    return Model(means, np.array(factors), np.array(logs), float(n[1] / n.sum()))


def apply(rows: DataFrame, model: Model) -> DataFrame:
    """``rows(doc_id, x)`` with ``score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return crc_mod(doc_id, 4) == 2


def labelled_moments(docs: DataFrame, labels: DataFrame, rows: int = TRAIN) -> DataFrame:
    """Moments of the labelled rows that are not held out, ``rows`` labels at most.

    A worker reads a text and adds its statistics up: two functions in a row would keep a second Python worker for
    each core, which Spark hands to later stages in turn, so that all of them come to hold what only some need.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    known = known.select(F.col("doc_id").cast("long").alias("known"), F.col("quality").cast("int").alias("label"))
    some = materialize(known.orderBy(F.xxhash64("known"), "known", "label").limit(rows), "quality-labels")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), F.col("doc_id") == F.col("known"))
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _moments((np.array([statistics(t.as_py()) for t in b.column("text")], dtype=float), b.column("label").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows)
        release_memory()

    return own.select("text", "label").mapInArrow(run, MOMENTS)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN) -> Model:
    """Model from labelled rows that are not held out, ``rows`` labels at most."""
    return _model(labelled_moments(docs, labels, rows))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text)``."""
    scored = apply(with_statistics(docs), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose whole text scores ``threshold`` or more; scored where they are read."""
    model = train(docs, labels)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        x = np.array([statistics(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x))

    return docs.where(score(F.col("text")) >= threshold)

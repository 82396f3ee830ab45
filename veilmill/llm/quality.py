"""Quality classification by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics (``features``).  Counts, sums and outer products
of the labelled rows are added up by class on the executors; the driver gets one small table whatever
the number of rows.  Class covariances are shrunk towards the pooled one and a multiple of the identity,
and their Cholesky factors are kept with the model.  The score is the logistic function of the difference
of the two log densities (Mahalanobis distance, log determinant and prior).

Defined results: null and empty texts get a score like any other (all their statistics are zero).  If only
one class was learned every score is 1 or 0 for that class, with none 0.5.  Labels that are null or other
than 0 and 1 don't count; an id labelled twice counts twice, one document twice in the table likewise.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmill.llm.common import fold, text_udf

POOLED = 0.3  #: weight of the pooled covariance in that of a class
IDENTITY = 0.05  #: weight of the identity, scaled to the mean variance

_SYMBOLS = b"#*$%&|<>@^~=_{}[]\\/+"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b".,;:!?"
_MULTI = bytes(range(128, 192))  # bytes that continue a character
_LOUD = re.compile(r"[!?]{2,}")
_NAMES = (
    "words", "mean word", "long words", "symbols", "capitals", "digits", "marks", "loud marks", "distinct words",
    "repeated lines", "repeated pairs", "short lines", "shouted words",
)


def _logit(share: float) -> float:
    """A share of 0 to 1, stretched at both ends and bounded."""
    return math.log((share + 0.002) / (1.002 - share))


def _share(count: float, of: int, more: int) -> float:
    """A stretched share of ``of + more``: what a short text shows weighs less."""
    return _logit(min(1.0, count / (of + more)))


def features(text: str | None) -> list[float]:
    """Transformed statistics of a whole text, in the order of ``_NAMES``."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    size = len(raw)
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(_NAMES)
    without = lambda drop: size - len(raw.translate(None, drop))
    chars = sum(map(len, words))
    letters = max(1, chars - sum(raw.count(bytes([m])) for m in _MARKS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lowered = raw.lower().split()
    pairs = list(zip(lowered, lowered[1:], strict=False))
    return [
        math.log1p(n),
        math.log((chars + 50) / (n + 10)),
        _share(sum(len(w) > 20 for w in words), n, 20),
        _share(without(_SYMBOLS), size, 100),
        _share(without(_UPPER), letters, 100),
        _share(without(_DIGITS), size, 100),
        _share(without(_MARKS), size, 100),
        math.log1p(100 * len(_LOUD.findall(text)) / (n + 20)),
        _share(n - len(set(lowered)), n, 20) - _logit(max(0.0, 1 - 12 / math.sqrt(n + 145))),
        _share(len(lines) - len(set(lines)), len(lines), 4),
        _share(len(pairs) - len(set(pairs)), len(pairs), 20),
        _share(sum(len(x) < 30 for x in lines), len(lines), 4),
        _share(sum(1 for w in words if len(w) > 1 and w.isupper()), n, 20),
    ]


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and constants of classes 0 and 1."""

    prior: float | None  # score if fewer than two classes were learned
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(rows), self.prior)
        z = (rows - self.centre) / self.scale
        density = [
            k - 0.5 * np.square((z - m) @ f.T).sum(axis=1)
            for m, f, k in zip(self.means, self.factors, self.constants, strict=True)
        ]
        return 1.0 / (1.0 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task and class: the count, sums and outer products, one number a row."""
    d = len(_NAMES) + 1
    total = {0: np.zeros((d, d)), 1: np.zeros((d, d))}
    for batch in batches:
        for label, part in batch.groupby("label"):
            x = np.array([[1.0, *f] for f in part["features"]])
            total[int(label)] += x.T @ x
    for label, m in total.items():
        if m[0, 0]:
            yield pd.DataFrame({"label": label, "cell": np.arange(d * d), "value": m.ravel()})


def learn(labelled: DataFrame, given: str = "features", label: str = "label", *, pooled: float = POOLED, identity: float = IDENTITY) -> Discriminant:
    """Fit to all rows whose ``label`` is 0 or 1."""
    rows = labelled.select(F.col(given).alias("features"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    cells = rows.mapInPandas(_moments, "label int, cell int, value double").groupBy("label", "cell").agg(F.sum("value").alias("value"))
    d = len(_NAMES) + 1
    moments = np.zeros((2, d, d))
    for r in cells.collect():
        moments[r.label].flat[r.cell] = r.value
    counts = moments[:, 0, 0]
    if not counts.all():
        nothing = np.zeros(0)
        return Discriminant(float(counts[1] > 0) if counts.any() else 0.5, *[nothing] * 5)
    both = moments.sum(axis=0) / counts.sum()
    centre = both[0, 1:]
    scale = np.sqrt(np.maximum(np.diag(both)[1:] - centre**2, 1e-9))
    scale[scale < 1e-3] = 1.0
    raw_means = moments[:, 0, 1:] / counts[:, None]
    means = (raw_means - centre) / scale
    spread = [
        (moments[c, 1:, 1:] / counts[c] - np.outer(raw_means[c], raw_means[c])) / np.outer(scale, scale) for c in (0, 1)
    ]
    shared = (counts[0] * spread[0] + counts[1] * spread[1]) / counts.sum()
    factors, constants = [], []
    for c in (0, 1):
        s = (1 - pooled) * spread[c] + pooled * shared
        s = (1 - identity) * s + identity * max(np.trace(s) / (d - 1), 1e-3) * np.eye(d - 1)
        lower = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(lower))
        constants.append(math.log(counts[c] / counts.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(None, centre, scale, means, np.array(factors), np.array(constants))


def with_score(docs: DataFrame, model: Discriminant, text: str = "text", into: str = "score") -> DataFrame:
    """Add the score of ``text`` (0 to 1) as column ``into``; all rows and other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.scores(np.array([features(t) for t in batch]).reshape(-1, len(_NAMES))))

    return docs.withColumn(into, F.pandas_udf(score, "double")(F.col(text)))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``features, label`` of the documents outside the held-out third that have a quality label.

    The statistics are made before the join, so texts aren't exchanged.
    """
    known = labels.select(F.col("doc_id").alias("of_doc"), F.col("quality").alias("label")).where(
        (F.col("label").isin(0, 1)) & (fold(F.col("of_doc"), 3) != 1)
    )
    numbers = text_udf(lambda: features, "array<double>")
    rows = docs.where(fold(F.col("doc_id"), 3) != 1).select("doc_id", numbers(F.col("text")).alias("features"))
    return rows.join(known, rows.doc_id == known.of_doc).select("features", "label")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    model = learn(labelled_rows(docs, labels))
    rows = docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return with_score(rows, model).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with a score of 0.5 or more, with the columns they came with."""
    model = learn(labelled_rows(docs, labels))
    return with_score(docs, model, into="_quality_score").where("_quality_score >= 0.5").drop("_quality_score")

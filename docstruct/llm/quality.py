"""Quality classifier: a regularised quadratic discriminant over document statistics.

A text becomes a vector of transformed statistics. Each class has a mean and a covariance that is
shrunk towards the pooled covariance and then towards its own diagonal. The score of a text
is the posterior of class 1: a logistic of the difference of the classes' log densities, each
a squared Mahalanobis distance and a log determinant from a Cholesky factor that is computed once
and travels with the model.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import forget, give_back, without

_SYMBOLS = b"#*$%&|<>"
_DIGITS = b"0123456789"
_UPPER = bytes(range(65, 91))
_MARKS = b"!?"

STATISTICS = (
    "log_words",
    "mean_word",
    "spread_word",
    "symbols",
    "digits",
    "upper",
    "marks",
    "sentence_ends",
    "variety",
    "top_word",
    "next_same",
    "repeated_pairs",
    "dup_lines",
    "bare_words",
)


def statistics_of(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; zeros if it is null or has no word.

    Shares are square roots, which spreads out small shares and steadies their variance; counts are
    logarithms.
    """
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "replace")
    size = len(raw)

    def share(chars: bytes) -> float:
        return math.sqrt((size - len(raw.translate(None, chars))) / size)

    lengths = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    same = sum(map(str.__eq__, words, words[1:]))
    ends = sum(map(str.endswith, words, [(".", ",", ";", ":", ".\"")] * n))
    bare = sum(not w[0].isalnum() and len(w) == 1 for w in words)
    return [
        math.log1p(n),
        math.log(float(lengths.mean())),
        math.log1p(float(lengths.std())),
        share(_SYMBOLS),
        share(_DIGITS),
        share(_UPPER),
        share(_MARKS),
        math.sqrt(ends / n),
        math.log(len(counts)) / math.log(n) if n > 1 else 1.0,
        math.sqrt(counts.most_common(1)[0][1] / n),
        math.sqrt(same / n),
        math.sqrt(1 - pairs / (n - 1)) if n > 1 else 0.0,
        math.sqrt(1 - len(set(lines)) / len(lines)),
        math.sqrt(bare / n),
    ]


@F.pandas_udf(ArrayType(DoubleType()))
def statistics(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column of ``STATISTICS`` for a column of texts."""
    forget()
    for batch in texts:
        yield pd.Series([statistics_of(t) for t in batch], dtype=object)
        give_back()


@dataclass(frozen=True)
class Gaussian:
    mean: np.ndarray
    #: Lower Cholesky factor of the regularised covariance, and its inverse.
    factor: np.ndarray
    inverse: np.ndarray
    log_prior: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.inverse.T
        return self.log_prior - np.log(np.diag(self.factor)).sum() - 0.5 * (z * z).sum(axis=1)


@dataclass(frozen=True)
class Discriminant:
    """One Gaussian for each class seen; without any, or with one, the score is constant."""

    classes: dict[int, Gaussian]
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        d = self.classes[1].log_density(x) - self.classes[0].log_density(x)
        return 1 / (1 + np.exp(-np.clip(d, -700, 700)))


def moments(labelled: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sum and cross products of ``x`` for each ``label``.

    Added up on the map side: at most three rows, with a fixed number of columns, reach the driver.
    """
    d = len(STATISTICS)
    x = [F.col("x")[i] for i in range(d)]
    cells = [(i, j) for i in range(d) for j in range(i, d)]
    rows = (
        labelled.groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(x[i]).alias(f"s{i}") for i in range(d)],
            *[F.sum(x[i] * x[j]).alias(f"c{i}_{j}") for i, j in cells],
        )
        .filter(F.col("label").isin(0, 1))
        .collect()
    )
    out = {}
    for r in rows:
        cross = np.zeros((d, d))
        for i, j in cells:
            cross[i, j] = cross[j, i] = r[f"c{i}_{j}"]
        out[r["label"]] = (r["n"], np.array([r[f"s{i}"] for i in range(d)]), cross)
    return out


def fit(
    labelled: DataFrame,
    to_pooled: float = 0.5,
    to_diagonal: float = 0.1,
    floor: float = 1e-2,
) -> Discriminant:
    """Fit on ``x`` (statistics) and ``label`` (0 or 1; others and nulls are left out).

    ``to_pooled`` and ``to_diagonal`` are the weights of the shrinkage targets, ``floor`` a variance
    added everywhere. With one class the score is its smoothed share, with none one half.
    """
    found = moments(labelled)
    n = {k: found[k][0] if k in found else 0 for k in (0, 1)}
    if not (n[0] and n[1]):
        return Discriminant({}, (n[1] + 1) / (n[0] + n[1] + 2))
    means = {k: found[k][1] / n[k] for k in (0, 1)}
    within = {k: found[k][2] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)}
    pooled = (n[0] * within[0] + n[1] * within[1]) / (n[0] + n[1])
    classes = {}
    for k in (0, 1):
        cov = (1 - to_pooled) * within[k] + to_pooled * pooled
        cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov))
        cov = (cov + cov.T) / 2 + floor * np.eye(len(STATISTICS))
        factor = np.linalg.cholesky(cov)
        classes[k] = Gaussian(
            means[k], factor, np.linalg.inv(factor), math.log(n[k] / (n[0] + n[1]))
        )
    return Discriminant(classes)


def labelled_statistics(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """``x, label`` of the documents that have a label.

    Only keys and vectors are shuffled. A key with several labels has the smallest one, repeated
    documents count each time; null keys and labels are left out.
    """
    one = labels.groupBy(labels[key].alias("_key")).agg(F.min(labels[label_col]).alias("label"))
    one = one.filter(F.col("label").isNotNull())
    vectors = docs.select(docs[key].alias("_key"), statistics(docs[text_col]).alias("x"))
    return vectors.join(one, "_key").select("x", "label")


def score(model: Discriminant, text: Column) -> Column:
    """Score of a whole text, 0 to 1; a null or empty text has the score of all-zero statistics."""

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        for batch in texts:
            x = np.array([statistics_of(t) for t in batch]).reshape(-1, len(STATISTICS))
            yield pd.Series(model.score(x))
            give_back()

    return scores(text)


def score_documents(
    docs: DataFrame, model: Discriminant, text_col: str = "text", threshold: float = 0.7
) -> DataFrame:
    """Add ``score`` and ``predicted`` (1 from ``threshold`` on) to every row.

    Row by row: repeated rows get equal scores, an empty table stays empty, input columns
    called ``score`` or ``predicted`` are replaced.
    """
    scored = without(docs.withColumn("_score", score(model, docs[text_col])), "score", "predicted")
    return scored.withColumnRenamed("_score", "score").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )

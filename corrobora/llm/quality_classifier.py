"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corrobora.llm.common import LABEL_BOUND, held_out, label_sample, labelled, load

#: What :func:`document_statistics` measures, in its order.
STATISTICS = (
    "bytes", "words", "word_length", "upper", "digits", "symbols", "stops", "exclamations", "bars", "other_bytes",
    "distinct_words", "stutter", "distinct_lines", "line_words", "compression",
)


def _logit(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def document_statistics(text: str | None) -> list[float]:
    """Statistics of one whole text, each put on a scale on which classes are roughly normal.

    Counts are log(1 + n), shares are logits shrunk by half an occurrence, so
    that empty and very long texts have finite values. A null text counts as empty.
    """
    data = (text or "").encode()
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.lower().split()
    lines = [line for line in data.split(b"\n") if line]
    n, w, k = len(data), len(words), len(lines)
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    symbols = int(seen[[35, 42, 36, 37, 38, 60, 62, 64, 94, 95, 123, 125, 126]].sum())
    return [
        float(np.log1p(n)),
        float(np.log1p(w)),
        float(np.log((n + 1) / (w + 1))),
        _logit(upper, upper + lower),
        _logit(int(seen[48:58].sum()), n),
        _logit(symbols, n),
        _logit(int(seen[46]), n),
        _logit(int(seen[33]), n),
        _logit(int(seen[124]), n),
        _logit(int(seen[128:].sum()), n),
        _logit(len(set(words)), w),
        _logit(sum(map(eq, words, words[1:])), w),
        _logit(len(set(lines)), k),
        float(np.log((w + 1) / (k + 1))),
        float(np.log((len(zlib.compress(data, 1)) + 1) / (n + 1))),
    ]


def statistics_matrix(texts: pd.Series) -> np.ndarray:
    rows = [document_statistics(t) for t in texts]
    return np.array(rows, float).reshape(len(rows), len(STATISTICS))


@dataclass(frozen=True)
class Discriminant:
    """Class means, Cholesky factors of the shrunk covariances, and log weights."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    weights: tuple[float, ...]

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """One column per class: log prior, minus half of log determinant and squared Mahalanobis distance."""
        z = (x - self.centre) / self.scale
        out = []
        for mean, factor, weight in zip(self.means, self.factors, self.weights):
            solved = np.linalg.solve(factor, (z - mean).T)
            out.append(weight - np.log(np.diag(factor)).sum() - 0.5 * (solved**2).sum(axis=0))
        return np.stack(out, axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, rounded to 9 places; 0.5 where the model has learned from one class only."""
        if not len(x):
            return np.zeros(0)
        if len(self.means) < 2:
            return np.full(len(x), 0.5)
        both = self.log_densities(x)
        gap = np.clip(both[:, 1] - both[:, 0], -500, 500)
        return np.round(1 / (1 + np.exp(-gap)), 9)


#: Variance from which a statistic has a scale of its own; sums are rounded to 9 places.
LEAST_VARIANCE = 1e-6


def _definite(cov: np.ndarray) -> np.ndarray:
    """The matrix, with eigenvalues raised to a floor if any lies below it."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    floor = max(1e-7, 1e-6 * values[-1])
    return cov if values[0] >= floor else (vectors * np.maximum(values, floor)) @ vectors.T


def fit_moments(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float, ridge: float) -> Discriminant:
    """The discriminant from each class's (count, sums, sums of products).

    ``pool`` shrinks a class covariance towards the pooled one, ``ridge`` the
    result towards a multiple of the identity. A statistic that hardly varies
    (repeated rows, templates, very few labels) keeps its own unit, and no
    eigenvalue falls below what rounding of the sums can hide, so every table has a factor.
    """
    d = len(STATISTICS)
    moments = {k: m for k, m in moments.items() if m[0] > 0}
    if len(moments) < 2:
        return Discriminant(np.zeros(d), np.ones(d), (), (), ())
    total = sum(m[0] for m in moments.values())
    centre = sum(m[1] for m in moments.values()) / total
    spread = sum(m[2] for m in moments.values()) / total - np.outer(centre, centre)
    varies = np.diag(spread) > LEAST_VARIANCE
    scale = np.sqrt(np.where(varies, np.diag(spread), 1.0))
    means, covs, counts = [], [], []
    for k in sorted(moments):
        n, first, second = moments[k]
        mean = first / n
        covs.append((second / n - np.outer(mean, mean)) / np.outer(scale, scale))
        means.append((mean - centre) / scale)
        counts.append(n)
    pooled = sum(n * c for n, c in zip(counts, covs)) / total
    factors = []
    for cov in covs:
        shrunk = (1 - pool) * cov + pool * pooled
        shrunk = (1 - ridge) * shrunk + (ridge * max(np.trace(shrunk) / d, 1e-6)) * np.eye(d)
        factors.append(np.linalg.cholesky(_definite(shrunk)))
    return Discriminant(centre, scale, tuple(means), tuple(factors), tuple(float(np.log(n / total)) for n in counts))


def _partial_moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    d = len(STATISTICS)
    sums = {0: np.zeros((d + 1, d + 1)), 1: np.zeros((d + 1, d + 1))}
    for frame in frames:
        x = np.hstack([np.ones((len(frame), 1)), statistics_matrix(frame["text"])])
        for k in sums:
            part = x[frame["label"].to_numpy() == k]
            sums[k] += part.T @ part
    for k, s in sums.items():
        yield pd.DataFrame({"label": k, "cell": np.arange(s.size), "total": s.ravel()})


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABEL_BOUND, pool: float = 0.5, ridge: float = 0.02) -> Discriminant:
    """Fit on the labelled documents outside the held-out third, at most about ``bound`` of them.

    Partitions send their sums of products, a fixed number of cells; these are
    added as decimals, so that the model does not depend on their order.
    """
    rows = labelled(docs, label_sample(labels, "quality", bound))
    cells = (
        rows.mapInPandas(_partial_moments, "label int, cell int, total double")
        .groupBy("label", "cell")
        .agg(F.sum(F.col("total").cast("decimal(38,9)")).cast("double").alias("total"))
        .collect()
    )
    d = len(STATISTICS)
    tables = {0: np.zeros((d + 1) ** 2), 1: np.zeros((d + 1) ** 2)}
    for row in cells:
        tables[row["label"]][row["cell"]] = row["total"]
    moments = {}
    for k, flat in tables.items():
        s = flat.reshape(d + 1, d + 1)
        moments[k] = (s[0, 0], s[0, 1:], s[1:, 1:])
    return fit_moments(moments, pool, ridge)


def quality_score(model: Discriminant, text: Column) -> Column:
    """Score (0 to 1, higher: label 1 likelier) of a text column under ``model``."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(statistics_matrix(texts)))

    return score(text)


def accept(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that score ``least`` or more, with all their columns.

    Null and empty texts are scored like any other; repeated rows are scored
    alike; an empty table or one without labels keeps everything (score 0.5).
    """
    return docs.filter(quality_score(fit(docs, labels), docs["text"]) >= least)


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    scored = docs.select("doc_id", held_out().alias("held_out"), quality_score(fit(docs, labels), F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

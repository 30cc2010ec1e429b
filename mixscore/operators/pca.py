"""Principal components of standardised features, with reproducible signs and rank."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixscore.functions.scalars import component_name
from mixscore.functions.text import number, quoted
from mixscore.operators.moments import Moments, moments
from mixscore.operators.prepare import ColumnStats, centred
from mixscore.sources.shared import small_frame

# Below this eigenvalue a component is rounding noise and has no direction.
NULL_SPACE = 1e-9


@dataclass(frozen=True)
class PcaFit:
    """A fitted PCA: driver-side arrays of at most p x p numbers.

    ``loadings`` has one row per feature and one column per component. Null
    space components keep their place in the variance table with eigenvalue 0
    and have NaN loadings. ``ratio`` is NaN when nothing varies.
    """

    moments: Moments
    eigenvalues: np.ndarray
    ratio: np.ndarray
    loadings: np.ndarray

    @property
    def features(self) -> tuple[str, ...]:
        return self.moments.features

    @property
    def k(self) -> int:
        return len(self.eigenvalues)

    @property
    def rank(self) -> int:
        return int(np.sum(self.eigenvalues > 0))

    @property
    def cumulative(self) -> np.ndarray:
        return np.cumsum(self.ratio)


def fit_pca(df: DataFrame, features, weight: str | None = None) -> PcaFit:
    """PCA of the imputed, standardised features of every row of ``df``."""
    return pca_of_moments(moments(df, features, weight))


def pca_of_moments(m: Moments) -> PcaFit:
    """PCA from the p x p moment matrix; ``min(n, p)`` components."""
    if m.n < 2:
        raise ValueError("a principal component analysis needs at least two rows")
    values, vectors = np.linalg.eigh(m.correlation)
    k = min(m.n, len(m.features))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    real = values > NULL_SPACE
    # Components use divisor n - 1 while the features are scaled with divisor n.
    eigenvalues = np.where(real, values, 0.0) * m.n / (m.n - 1)
    total = np.count_nonzero(m.sd) * m.n / (m.n - 1)
    ratio = eigenvalues / total if total else np.full(k, np.nan)
    return PcaFit(m, eigenvalues, ratio, np.where(real, _signed(vectors), np.nan))


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Turn each column so that its largest loading is positive; the first one wins a tie."""
    strength = np.round(np.abs(vectors), 9)
    top = np.argmax(strength, axis=0)
    return vectors * np.where(vectors[top, range(vectors.shape[1])] < 0, -1.0, 1.0)


def variance_frame(spark: SparkSession, fit: PcaFit) -> DataFrame:
    """``(component, eigenvalue, ratio, cumulative)``, one row per component."""
    rows = [
        (i + 1, float(e), None if np.isnan(r) else float(r))
        for i, (e, r) in enumerate(zip(fit.eigenvalues, fit.ratio))
    ]
    schema = pa.schema([("component", pa.int32()), ("eigenvalue", pa.float64()), ("ratio", pa.float64())])
    # At most p rows, so one window over all of them is safe.
    running = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return small_frame(spark, rows, schema).withColumn("cumulative", F.sum("ratio").over(running))


def loadings_frame(spark: SparkSession, fit: PcaFit, k: int | None = None) -> DataFrame:
    """``(ord, feature, component, loading)`` for the first ``k`` components."""
    k = fit.k if k is None else min(k, fit.k)
    rows = [
        (i, f, j + 1, None if np.isnan(fit.loadings[i, j]) else float(fit.loadings[i, j]))
        for i, f in enumerate(fit.features)
        for j in range(k)
    ]
    schema = pa.schema(
        [("ord", pa.int32()), ("feature", pa.string()), ("component", pa.int32()), ("loading", pa.float64())]
    )
    return small_frame(spark, rows, schema)


def loadings_wide(spark: SparkSession, fit: PcaFit, k: int) -> DataFrame:
    """Features as rows, components ``PC1..PCk`` as columns."""
    k = min(k, fit.k)
    names = [f"PC{j + 1}" for j in range(k)]
    return (
        loadings_frame(spark, fit, k)
        .withColumn("pc", component_name(F.col("component")))
        .groupBy("ord", "feature")
        .pivot("pc", names)
        .agg(F.first("loading"))
    )


def score_columns(fit: PcaFit, k: int, values=quoted) -> list[Column]:
    """Scores on the first ``k`` components as expressions over the raw features.

    ``values`` turns a feature name into the SQL text that yields it. Scaling
    is folded into the coefficients: a score is a weighted sum of centred
    features. A component beyond the fit is null, one in the null space 0.
    """
    m = fit.moments
    stats = ColumnStats(m.features, m.n, (m.n,) * len(m.features), tuple(map(float, m.mean)), tuple(m.sd == 0))
    deviations = centred(stats, values)
    columns = []
    for j in range(k):
        if j >= fit.k:
            columns.append(number(None))
        elif np.isnan(fit.loadings[0, j]):
            columns.append(number(0.0))
        else:
            columns.append(
                " + ".join(
                    f"{d} * {number(fit.loadings[i, j] / m.sd[i])}"
                    for i, d in enumerate(deviations)
                    if m.sd[i] > 0
                )
            )
    return [F.expr(c) for c in columns]


def project(df: DataFrame, fit: PcaFit, k: int, prefix: str = "PC", values=quoted) -> DataFrame:
    """``df`` with the scores on its first ``k`` components appended."""
    return df.withColumns({f"{prefix}{j + 1}": c for j, c in enumerate(score_columns(fit, k, values))})

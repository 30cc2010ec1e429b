"""Second moments of a feature table: one p x p matrix from any number of rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession

from mixscore.functions.text import number, present, quoted
from mixscore.operators.prepare import centred, column_stats
from mixscore.sources.shared import small_frame


# Up to this many features the products are plain sums, 78 at most: they fit one
# generated loop, several times faster than filling vectors. Beyond it Spark
# would give up whole-stage code generation for the aggregate.
SUMMED_FEATURES = 6

# Rows whose medians are the first guess of the centres.
GUESSED_FROM = 1000

# Squared distance of guess and mean, in variances, up to which the shifted
# sums lose nothing: six of sixteen digits cancel at most.
FAR = 1e6


@dataclass(frozen=True)
class Moments:
    """Means and population covariance of the imputed features over ``n`` rows."""

    features: tuple[str, ...]
    n: int
    mean: np.ndarray
    covariance: np.ndarray

    @property
    def sd(self) -> np.ndarray:
        return np.sqrt(np.diag(self.covariance))

    @property
    def correlation(self) -> np.ndarray:
        return correlation_of(self.covariance)


def correlation_of(covariance: np.ndarray) -> np.ndarray:
    """Covariance of the standardised features; rows of constant features are 0."""
    sd = np.sqrt(np.diag(covariance))
    scale = np.where(sd > 0, 1.0 / np.where(sd > 0, sd, 1.0), 0.0)
    corr = covariance * np.outer(scale, scale)
    np.fill_diagonal(corr, np.where(sd > 0, 1.0, 0.0))
    return corr


def moments(df: DataFrame, features, weight: str | None = None) -> Moments:
    """Moments of the mean-imputed features from one scan.

    Values are shifted by a guess of their centre, a value found among the
    first rows, and their sums and products are taken over the rows where both
    features are present; the exact means then move the centre. Where the guess
    turns out to be far off, means and centred products take two scans.
    A column is constant if none of its values differs from the guess.
    ``weight`` names a column of row multiplicities.
    """
    features = tuple(features)
    if not features:
        raise ValueError("no features given")
    p = len(features)
    guess = _guess(df, features)
    if guess is None:
        return _two_scans(df, features, weight)
    values = [f"({present(quoted(f))} - {number(g)})" for f, g in zip(features, guess)]
    rows = df.selectExpr(
        *[f"{v} AS x{i}" for i, v in enumerate(values)],
        "1.0D AS w" if weight is None else f"CAST({quoted(weight)} AS DOUBLE) AS w",
    )
    products = _summed_products if p <= SUMMED_FEATURES else _gram_matrix
    n, product, total, both = products(rows, p)
    if not np.isfinite(product).all() or (np.diag(both) == 0).any():
        return _two_scans(df, features, weight)  # says which feature can't be used
    shift = np.diag(total) / np.diag(both)  # of the means from the guess
    centred_sums = product - total * shift - (total * shift).T + both * np.outer(shift, shift)
    varies = np.diag(product) > 0
    spread = np.diag(centred_sums) / np.diag(both)
    if (varies & ~(shift**2 <= FAR * spread)).any():
        return _two_scans(df, features, weight)
    return Moments(features, int(n), guess + shift, centred_sums / n)


def _guess(df: DataFrame, features) -> np.ndarray | None:
    """The lower median of each feature in the first rows; None if one has no value there."""
    rows = df.selectExpr(*[f"{present(quoted(f))} AS x{i}" for i, f in enumerate(features)]).limit(GUESSED_FROM).collect()
    out = []
    for column in zip(*rows):
        found = sorted(v for v in column if v is not None)
        if not found:
            return None
        out.append(found[(len(found) - 1) // 2])
    return np.array(out) if out and np.isfinite(out).all() else None


def _summed_products(rows: DataFrame, p: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, products, sums of the first and rows with both, for each pair; all in one generated loop."""
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    texts = ["sum(w)"]
    for i, j in pairs:  # null where either is missing
        texts += [f"sum(x{i} * x{j} * w)", f"sum(IF(x{i} IS NULL OR x{j} IS NULL, 0.0D, w))"]
    ordered = [(i, j) for i in range(p) for j in range(p)]
    texts += [f"sum(IF(x{j} IS NULL, NULL, x{i} * w))" for i, j in ordered]
    row = [v or 0.0 for v in rows.selectExpr(*texts).first()]
    product, total, both = np.zeros((p, p)), np.zeros((p, p)), np.zeros((p, p))
    for k, (i, j) in enumerate(pairs):
        product[i, j] = product[j, i] = row[1 + 2 * k]
        both[i, j] = both[j, i] = row[2 + 2 * k]
    for k, (i, j) in enumerate(ordered):
        total[i, j] = row[1 + 2 * len(pairs) + k]
    return row[0], product, total, both


def _gram_matrix(rows: DataFrame, p: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The same from MLlib's Gram matrix of values and marks of their presence.

    A tree aggregation that ships one packed triangle per task. A row standing
    for ``w`` equal rows enters scaled by its square root.
    """
    scaled = rows.selectExpr(
        *[f"coalesce(x{i}, 0.0D) * sqrt(w) AS v{i}" for i in range(p)],
        *[f"IF(x{i} IS NULL, 0.0D, sqrt(w)) AS m{i}" for i in range(p)],
        "sqrt(w) AS every",
    )
    vectors = VectorAssembler(inputCols=scaled.columns, outputCol="v").transform(scaled).select("v")
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), numCols=2 * p + 1)
    gram = matrix.computeGramianMatrix().toArray()
    return float(np.rint(gram[-1, -1])), gram[:p, :p], gram[:p, p:-1], gram[p:-1, p:-1]


def _two_scans(df: DataFrame, features, weight: str | None) -> Moments:
    """Means first, then products of centred values."""
    stats = column_stats(df, features, weight)
    p = len(stats.features)
    rows = df.selectExpr(
        *[f"{c} AS x{i}" for i, c in enumerate(centred(stats))],
        "1.0D AS w" if weight is None else f"CAST({quoted(weight)} AS DOUBLE) AS w",
    )
    products = _summed_products if p <= SUMMED_FEATURES else _gram_matrix
    return Moments(stats.features, stats.n, np.array(stats.mean), products(rows, p)[1] / stats.n)


def correlation_frame(spark: SparkSession, m: Moments) -> DataFrame:
    """The upper triangle of the correlation matrix as ``(feature_a, feature_b, corr)``."""
    corr = m.correlation
    p = len(m.features)
    return small_frame(
        spark,
        [(m.features[i], m.features[j], float(corr[i, j])) for i in range(p) for j in range(i, p)],
        pa.schema([("feature_a", pa.string()), ("feature_b", pa.string()), ("corr", pa.float64())]),
    )

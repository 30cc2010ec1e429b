"""Feature preparation: selection, mean imputation, weighting, standardising."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixscore.functions.text import number, present, quoted


# Features of one aggregation, so that its buffers stay within the 100 fields of
# whole-stage code generation. Each pass reads its own columns only: together
# the passes read every column once.
FEATURES_PER_PASS, FEATURES_PER_PASS_SD = 16, 12


@dataclass(frozen=True)
class ColumnStats:
    """Per-feature statistics over the non-missing values of ``n`` rows."""

    features: tuple[str, ...]
    n: int
    present: tuple[int, ...]
    mean: tuple[float, ...]
    constant: tuple[bool, ...]
    sd: tuple[float, ...] | None = None


def available_features(df: DataFrame, features) -> list[str]:
    """The listed features that ``df`` has, in list order."""
    return [f for f in features if f in df.columns]


def column_stats(df: DataFrame, features, weight: str | None = None, with_sd: bool = False) -> ColumnStats:
    """Everything imputing and centring need, from one aggregation per 16 features.

    ``weight`` names a column of row multiplicities. A feature whose minimum
    equals its maximum is constant; that test is exact where a variance
    compared with zero is not. ``with_sd`` adds the population standard
    deviation after mean imputation, for unweighted rows only: imputed rows
    sit on the mean, so only the divisor changes.
    """
    features = tuple(features)
    if not features:
        raise ValueError("no features given")
    if with_sd and weight is not None:
        raise ValueError("standard deviations are computed for unweighted rows only")
    step = FEATURES_PER_PASS_SD if with_sd else FEATURES_PER_PASS
    row = {}
    for start in range(0, len(features), step):
        row |= _stats_pass(df, features, range(start, min(start + step, len(features))), weight, with_sd)

    n = row["n"] or 0
    span = range(len(features))
    for i in span:
        if not row[f"present_{i}"]:
            raise ValueError(f"feature {features[i]!r} has no values")
        if math.isinf(row[f"low_{i}"]) or math.isinf(row[f"high_{i}"]):
            raise ValueError(f"feature {features[i]!r} holds infinite values")
    constant = tuple(row[f"low_{i}"] == row[f"high_{i}"] for i in span)
    counts = tuple(int(row[f"present_{i}"]) for i in span)
    return ColumnStats(
        features=features,
        n=int(n),
        present=counts,
        mean=tuple(row[f"low_{i}"] if constant[i] else row[f"mean_{i}"] for i in span),
        constant=constant,
        sd=tuple(
            0.0 if constant[i] else row[f"sd_{i}"] * math.sqrt(counts[i] / n) for i in span
        )
        if with_sd
        else None,
    )


def _stats_pass(df: DataFrame, features, chosen: range, weight: str | None, with_sd: bool) -> dict:
    values = df.selectExpr(
        *[f"{present(quoted(features[i]))} AS x{i}" for i in chosen],
        "1 AS w" if weight is None else f"{quoted(weight)} AS w",
    )
    aggs = ["count(1) AS n" if weight is None else "sum(w) AS n"]
    for i in chosen:
        if weight is None:
            aggs += [f"count(x{i}) AS present_{i}", f"avg(x{i}) AS mean_{i}"]
        else:
            weights = f"sum(IF(x{i} IS NULL, NULL, w))"
            aggs += [f"{weights} AS present_{i}", f"sum(x{i} * w) / {weights} AS mean_{i}"]
        aggs += [f"min(x{i}) AS low_{i}", f"max(x{i}) AS high_{i}"]
        if with_sd:
            aggs.append(f"stddev_pop(x{i}) AS sd_{i}")
    return values.selectExpr(*aggs).first().asDict()


def impute_mean(df: DataFrame, features, stats: ColumnStats | None = None) -> DataFrame:
    """Replace missing values (null or NaN) by the column mean."""
    stats = stats or column_stats(df, features)
    means = dict(zip(stats.features, stats.mean))
    return df.withColumns(
        {f: F.expr(f"coalesce({present(quoted(f))}, {number(means[f])})") for f in features}
    )


def weight_features(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Multiply each feature by its weight."""
    return df.withColumns({f: F.expr(f"{quoted(f)} * {number(w)}") for f, w in weights.items()})


def centred(stats: ColumnStats, values=quoted) -> list[str]:
    """SQL text of each imputed value minus its mean; 0 if missing or if the column is constant.

    ``values`` turns a feature name into the SQL text that yields it.
    """
    return [
        number(0.0) if constant else f"coalesce({present(values(f))} - {number(mean)}, 0.0D)"
        for f, mean, constant in zip(stats.features, stats.mean, stats.constant)
    ]


def standardise(df: DataFrame, features, suffix: str = "") -> DataFrame:
    """Impute, centre and scale to unit population variance; a constant column becomes 0."""
    stats = column_stats(df, features, with_sd=True)
    return df.withColumns(
        {
            f + suffix: F.expr(text if sd == 0.0 else f"{text} / {number(sd)}")
            for f, text, sd in zip(stats.features, centred(stats), stats.sd)
        }
    )

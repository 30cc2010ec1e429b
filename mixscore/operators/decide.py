"""Decisions on a fitted PCA: thresholds, headline figures, feature weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixscore.functions.scalars import fixed_text, floor_weight
from mixscore.functions.text import number, numbers
from mixscore.operators.moments import Moments
from mixscore.operators.pca import PcaFit
from mixscore.sources.shared import small_frame

# Threshold on PC1 + PC2, weight floor, cap on tried weightings.
THRESHOLD = 0.85
FLOOR = 0.1
CANDIDATES = 1000

# Distances from the threshold within this much of the smallest are equal: standardising
# cancels every positive weight, so they differ by rounding only.
TIE = 1e-9

# A candidate costs microseconds: a few tasks do, whatever the cluster's default.
CANDIDATES_PER_TASK = 250


# Place of a candidate's weight in its range, in SQL: strides that share no factor with the modulus.
SPREAD = "({id} * (7919 + 104729 * {j}) + 611953 * {j}) % 1000003"


def search_needed(fit: PcaFit, threshold: float = THRESHOLD) -> bool:
    """Whether PC1 + PC2 stay below the threshold; never when nothing varies."""
    return bool(fit.k >= 2 and fit.cumulative[1] < threshold)


def components_to(fit: PcaFit, threshold: float = THRESHOLD) -> int:
    """First component at which the running ratio reaches the threshold, else the last."""
    reached = np.flatnonzero(fit.cumulative >= threshold)
    return int(reached[0]) + 1 if len(reached) else fit.k


def decision(variance: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row: headline percentages, search decision, components to the threshold."""
    component, ratio, cumulative = F.col("component"), F.col("ratio"), F.col("cumulative")
    second = F.max(F.when(component == 2, cumulative))
    return variance.agg(
        (F.max(F.when(component == 1, ratio)) * 100).alias("pc1_pct"),
        (F.max(F.when(component == 2, ratio)) * 100).alias("pc2_pct"),
        (second * 100).alias("pc12_pct"),
        F.coalesce(second < threshold, F.lit(False)).alias("search_needed"),
        F.coalesce(F.min(F.when(cumulative >= threshold, component)), F.max(component)).alias("n_to_threshold"),
    )


def headline(decided: DataFrame) -> DataFrame:
    """The percentages of ``decision`` as printed: two decimals, beside the exact values."""
    names = ("pc1_pct", "pc2_pct", "pc12_pct")
    return decided.select(*names, *[fixed_text(F.col(n), 2).alias(n.replace("pct", "text")) for n in names])


def kaiser(variance: DataFrame) -> DataFrame:
    """Eigenvalues with a flag for those of at least 1."""
    return variance.select("component", "eigenvalue", (F.col("eigenvalue") >= 1).alias("kaiser"))


def candidate_weights(
    spark: SparkSession, initial: dict[str, float], n: int = CANDIDATES, floor: float = FLOOR
) -> DataFrame:
    """``n`` weightings by rule, floored: ``(cand_id, weights array)``.

    Candidate 0 is the initial weighting, candidates 1..p raise one weight by
    5 %, the rest spread over ``[floor, 5)`` by a linear rule on candidate and feature.
    """
    base = numbers(initial.values())
    spread = f"({SPREAD.format(id='id', j='j')}) / 1000003D * {number(5.0 - floor)} + {number(floor)}"
    tried = F.expr(
        f"transform({base}, (w, j) -> CASE WHEN id = j + 1 THEN w * 1.05D "
        f"WHEN id <= {len(initial)} THEN w ELSE {spread} END)"
    )
    weights = F.transform(tried, lambda w: floor_weight(w, floor))
    tasks = max(1, n // CANDIDATES_PER_TASK)
    return spark.range(0, n, 1, tasks).select(F.col("id").alias("cand_id"), weights.alias("weights"))


def sweep_weights(candidates: DataFrame, m: Moments, threshold: float = THRESHOLD) -> DataFrame:
    """PC1 + PC2 and its distance from the threshold for every candidate.

    Each candidate re-weights the p x p covariance, standardises it and takes
    its spectrum, so no candidate reads the rows again.
    """
    covariance = m.covariance

    def evaluate(batches):
        for batch in batches:
            w = np.stack(batch["weights"].to_numpy())
            weighted = covariance * w[:, :, None] * w[:, None, :]
            sd = np.sqrt(np.einsum("nii->ni", weighted))
            scale = np.where(sd > 0, 1.0 / np.where(sd > 0, sd, 1.0), 0.0)
            spectrum = np.linalg.eigvalsh(weighted * scale[:, :, None] * scale[:, None, :])
            share = spectrum[:, -2:].sum(axis=1) / spectrum.sum(axis=1)
            yield pd.DataFrame(
                {
                    "cand_id": batch["cand_id"],
                    "weights": batch["weights"],
                    "cum2": share,
                    "objective": np.abs(share - threshold),
                }
            )

    return candidates.mapInPandas(
        evaluate, "cand_id bigint, weights array<double>, cum2 double, objective double"
    )


def best_candidate(swept: DataFrame) -> DataFrame:
    """The candidate closest to the threshold; the lowest id among those within ``TIE`` of it.

    So candidate 0, the initial weights, stays unless another is closer by more.
    The window sees one row for each candidate, `CANDIDATES` by default.
    """
    near = swept.withColumn("least", F.min("objective").over(_whole())).where(F.col("objective") <= F.col("least") + TIE)
    return near.agg(F.min_by(F.struct("cand_id", "weights", "cum2", "objective"), "cand_id").alias("best")).select("best.*")


def used_weights(
    spark: SparkSession, fit: PcaFit, initial: dict[str, float], threshold: float = THRESHOLD,
    floor: float = FLOOR, n: int = CANDIDATES,
) -> dict[str, float]:
    """Weights the analysis reports: the initial ones, or the sweep's winner below the threshold."""
    weights = {f: float(initial[f]) for f in fit.features}
    if not search_needed(fit, threshold):
        return weights
    swept = sweep_weights(candidate_weights(spark, weights, n, floor), fit.moments, threshold)
    return dict(zip(weights, best_candidate(swept).first()["weights"]))


def weight_table(spark: SparkSession, weights: dict[str, float], labels: dict[str, str]) -> DataFrame:
    """``(ord, property, label, weight, below_median)`` in feature order."""
    rows = [(i, f, labels.get(f, f), float(w)) for i, (f, w) in enumerate(weights.items())]
    schema = pa.schema(
        [("ord", pa.int32()), ("property", pa.string()), ("label", pa.string()), ("weight", pa.float64())]
    )
    return flag_below_median(small_frame(spark, rows, schema), F.col("weight"))


def flag_below_median(table: DataFrame, value: Column) -> DataFrame:
    """Mark values under the median of a table with one row per feature."""
    return table.withColumn("below_median", value < F.median(value).over(_whole()))


def flag_strong(table: DataFrame, value: Column, quantile: float = 0.67) -> DataFrame:
    """Mark values from the interpolated quantile up, in a table with one row per feature."""
    return table.withColumn("is_strong", value >= F.percentile(value, F.lit(quantile)).over(_whole()))


def _whole():
    return Window.partitionBy(F.lit(0))

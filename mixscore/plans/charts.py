"""Chart-ready tables: what each figure plots, without drawing it.

Summaries come from the distinct-profile table; only point sets read the
measurement rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixscore.functions.scalars import component_name, fixed_text, vector_norm, with_default
from mixscore.functions.text import quoted
from mixscore.operators.decide import THRESHOLD, components_to, decision, flag_strong, headline, kaiser, weight_table
from mixscore.operators.groups import group_ellipse, group_ordinals
from mixscore.operators.pca import PcaFit, loadings_wide, variance_frame
from mixscore.plans.model import ProfileModel, fitted_rows
from mixscore.plans.report import labelled
from mixscore.sources.dictionary import DISPLAY_LABELS

# Second guide line of the cumulative curve, label decimals,
# arrow and text scales of the loading plot and of the biplot.
UPPER_GUIDE = 0.90
ARROW_TIP, ARROW_LABEL = 0.92, 1.03
BIPLOT_TIP, BIPLOT_LABEL = 0.55, 0.62


def scree(variance: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Ratio and running ratio per component; the first two are highlighted."""
    return variance.select(
        "component", "ratio", "cumulative",
        (F.col("component") <= 2).alias("is_top2"),
        F.lit(threshold).alias("threshold"),
    )


def variance_percent(variance: DataFrame, k: int = 10) -> DataFrame:
    """Percentages of the first ``k`` components with their bar labels."""
    return variance.where(F.col("component") <= k).select(
        "component",
        (F.col("ratio") * 100).alias("ratio_pct"),
        (F.col("cumulative") * 100).alias("cumulative_pct"),
        fixed_text(F.col("ratio") * 100, 1).alias("bar_label"),
    )


def axis_labels(variance: DataFrame, k: int = 3) -> DataFrame:
    """Axis titles of the score and loading plots, such as ``PC1 (49.0%)``."""
    share = fixed_text(F.col("ratio") * 100, 1)
    return variance.where(F.col("component") <= k).select(
        "component",
        F.concat(component_name(F.col("component")), F.lit(" ("), share, F.lit("%)")).alias("axis_label"),
    )


def score_points(model: ProfileModel, rows: DataFrame | None = None) -> DataFrame:
    """PC1 and PC2 of every row with its group and the group's colour."""
    return _points(model, rows, ("PC1", "PC2"))


def score_points_3d(model: ProfileModel, rows: DataFrame | None = None) -> DataFrame:
    """PC1 to PC3 of every row with its group and colour; needs three components."""
    if model.fit.k < 3:
        raise ValueError("a 3-D point set needs at least three components")
    return _points(model, rows, ("PC1", "PC2", "PC3"))


def _points(model: ProfileModel, rows: DataFrame | None, names) -> DataFrame:
    rows = fitted_rows(model) if rows is None else rows
    # One row per label of the dictionary, plus 'Other'.
    colours = F.broadcast(label_ordinals(model).select("Solvent_Main", "colour"))
    return rows.select(
        F.col(quoted(model.row_id)).alias("row_id"), "Solvent_Main", *[F.col(f"Solvent_{n}").alias(n) for n in names]
    ).join(colours, "Solvent_Main", "left").select("row_id", "Solvent_Main", "colour", *names)


def label_ordinals(model: ProfileModel) -> DataFrame:
    """Main labels in order of first appearance with their colour index."""
    firsts = model.profiles.select("Solvent_Main", F.col("first_row"))
    return group_ordinals(firsts, "Solvent_Main", "first_row", few_groups=True)


def label_ellipses(model: ProfileModel) -> DataFrame:
    """Covariance ellipse of PC1 and PC2 per main label."""
    return group_ellipse(model.scored_profiles(), "Solvent_Main", "PC1", "PC2", weight="n_rows", few_groups=True)


def loading_vectors(spark: SparkSession, fit: PcaFit) -> DataFrame:
    """``(ord, feature, PC1, PC2, strength)``, one row per feature."""
    return loadings_wide(spark, fit, 2).withColumn("strength", vector_norm(F.col("PC1"), F.col("PC2")))


def loading_arrows(spark: SparkSession, fit: PcaFit, labels: dict[str, str] = DISPLAY_LABELS) -> DataFrame:
    """Arrow tips, label anchors and texts, and the strong loadings of the loading plot."""
    x, y = F.col("PC1"), F.col("PC2")
    return flag_strong(loading_vectors(spark, fit), F.col("strength")).select(
        "ord", "feature", with_default(labels, F.col("feature")).alias("label"), "strength", "is_strong",
        (x * ARROW_TIP).alias("tip_x"), (y * ARROW_TIP).alias("tip_y"),
        (x * ARROW_LABEL).alias("label_x"), (y * ARROW_LABEL).alias("label_y"),
    )


def loadings_heatmap(
    spark: SparkSession, fit: PcaFit, k: int = 8, labels: dict[str, str] = DISPLAY_LABELS
) -> DataFrame:
    """Loadings of the first ``k`` components per property, with cell texts."""
    wide = labelled(loadings_wide(spark, fit, k), labels)
    cells = [c for c in wide.columns if c != "Property"]
    return wide.select("*", *[fixed_text(F.col(c), 2).alias(f"{c}_text") for c in cells])


def cumulative_curve(variance: DataFrame, n_to_threshold: int, threshold: float = THRESHOLD) -> DataFrame:
    """Running percentage per component with the guide lines."""
    return variance.select(
        "component",
        (F.col("cumulative") * 100).alias("cumulative_pct"),
        F.lit(threshold * 100).alias("lower_guide"),
        F.lit(UPPER_GUIDE * 100).alias("upper_guide"),
        (F.col("component") == n_to_threshold).alias("reaches_threshold"),
    )


def weight_bars(model: ProfileModel, labels: dict[str, str] = DISPLAY_LABELS) -> DataFrame:
    """Feature weights in ascending order; equal weights by property."""
    table = weight_table(model.measurements.sparkSession, model.weights, labels)
    return table.orderBy("weight", "property").select(
        "label", "weight", "below_median", fixed_text(F.col("weight"), 2).alias("weight_text")
    )


def eigenvalue_bars(variance: DataFrame) -> DataFrame:
    """Eigenvalues with the flag for those of at least 1."""
    return kaiser(variance)


def score_extent(model: ProfileModel) -> tuple[float, float]:
    """Largest absolute PC1 and PC2 score."""
    row = model.scored_profiles().agg(F.max(F.abs("PC1")).alias("x"), F.max(F.abs("PC2")).alias("y")).first()
    return row["x"], row["y"]


def biplot_arrows(
    spark: SparkSession, fit: PcaFit, extent: tuple[float, float], labels: dict[str, str] = DISPLAY_LABELS
) -> DataFrame:
    """Loadings stretched to the extent of the scores, with the texts at their ends."""
    x, y = F.col("PC1") * F.lit(extent[0]), F.col("PC2") * F.lit(extent[1])
    return loading_vectors(spark, fit).select(
        "ord", "feature", with_default(labels, F.col("feature")).alias("label"),
        (x * BIPLOT_TIP).alias("tip_x"), (y * BIPLOT_TIP).alias("tip_y"),
        (x * BIPLOT_LABEL).alias("label_x"), (y * BIPLOT_LABEL).alias("label_y"),
    )


def biplot_points(model: ProfileModel, rows: DataFrame | None = None) -> DataFrame:
    """PC1 and PC2 of every row."""
    rows = fitted_rows(model) if rows is None else rows
    return rows.select(
        F.col(quoted(model.row_id)).alias("row_id"), F.col("Solvent_PC1").alias("PC1"), F.col("Solvent_PC2").alias("PC2")
    )


def summary_charts(model: ProfileModel, labels: dict[str, str] = DISPLAY_LABELS) -> dict[str, DataFrame]:
    """Every chart table of bounded size by name.

    The point sets (``score_points``, ``score_points_3d``, ``biplot_points``)
    have one row per measurement and are columns of the score table.
    """
    spark, fit, threshold = model.measurements.sparkSession, model.fit, model.threshold
    variance = variance_frame(spark, fit)
    return {
        "scree": scree(variance, threshold),
        "variance_percent": variance_percent(variance),
        "headline": headline(decision(variance, threshold)),
        "axis_labels": axis_labels(variance),
        "label_colours": label_ordinals(model),
        "label_ellipses": label_ellipses(model),
        "loading_arrows": loading_arrows(spark, fit, labels),
        "loadings_heatmap": loadings_heatmap(spark, fit, labels=labels),
        "cumulative_curve": cumulative_curve(variance, components_to(fit, threshold), threshold),
        "weight_bars": weight_bars(model, labels),
        "eigenvalue_bars": eigenvalue_bars(variance),
        "biplot_arrows": biplot_arrows(spark, fit, score_extent(model), labels),
    }

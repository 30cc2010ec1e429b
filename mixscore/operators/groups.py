"""Per-group summaries: covariance ellipses and first-seen ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixscore.operators.ranks import row_numbers

# Ellipse half-axis in standard deviations, smallest group, palette length.
ELLIPSE_SD = 1.7
MIN_GROUP = 3
PALETTE = 12

# Shares that are rounding noise: of a group's own spread, and of its centre's
# distance from the origin, by which points that coincide may differ.
FLAT = 1e-12
CENTRE_NOISE = 1e-15


def group_covariance(
    df: DataFrame, group: str, x: str, y: str, weight: str | None = None, few_groups: bool = False
) -> DataFrame:
    """``(group, n, cx, cy, var_x, var_y, cov_xy)``, sample moments per non-null group.

    Both forms combine on the map side, so a hot group costs one row per task.
    With ``weight``, a column of row multiplicities, centres come first and
    products second; the join between them is on one row per group. A caller
    whose groups are bounded in number, such as a dictionary's labels, says
    ``few_groups``: the centres are then broadcast and a hot group isn't shuffled.
    """
    df = df.where(F.col(group).isNotNull())
    if weight is None:
        return df.groupBy(group).agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(x).alias("cx"),
            F.avg(y).alias("cy"),
            F.var_samp(x).alias("var_x"),
            F.var_samp(y).alias("var_y"),
            F.covar_samp(x, y).alias("cov_xy"),
        )
    w = F.col(weight)
    centres = df.groupBy(group).agg(
        F.sum(w).alias("n"),
        (F.sum(w * F.col(x)) / F.sum(w)).alias("cx"),
        (F.sum(w * F.col(y)) / F.sum(w)).alias("cy"),
    )
    dx, dy, divisor = F.col(x) - F.col("cx"), F.col(y) - F.col("cy"), F.nullif(F.col("n") - 1, F.lit(0))
    return (
        df.join(F.broadcast(centres) if few_groups else centres, group)
        .groupBy(group, "n", "cx", "cy")
        .agg(F.sum(w * dx * dx).alias("sxx"), F.sum(w * dy * dy).alias("syy"), F.sum(w * dx * dy).alias("sxy"))
        .select(
            group, "n", "cx", "cy",
            (F.col("sxx") / divisor).alias("var_x"),
            (F.col("syy") / divisor).alias("var_y"),
            (F.col("sxy") / divisor).alias("cov_xy"),
        )
    )


def group_ellipse(
    df: DataFrame, group: str, x: str, y: str, weight: str | None = None, n_sd: float = ELLIPSE_SD,
    few_groups: bool = False,
) -> DataFrame:
    """Centre, axes and angle of each group's covariance ellipse.

    Groups of fewer than three rows, and groups without a finite covariance,
    have none; every other group has one row. Points on a line, or that
    coincide, have an axis of length zero and are marked ``degenerate``; what
    counts as zero is relative to the group's own scale. The angle of the major
    axis is in degrees, in (-90, 90].
    """
    a, b, c = F.col("var_x"), F.col("cov_xy"), F.col("var_y")
    b = F.when(F.abs(b) <= FLAT * F.sqrt(a * c), 0.0).otherwise(b)
    half_gap = F.sqrt(((a - c) / 2) * ((a - c) / 2) + b * b)
    finite = a + b + c
    moments = group_covariance(df, group, x, y, weight, few_groups).where(
        (F.col("n") >= MIN_GROUP) & finite.isNotNull() & ~F.isnan(finite) & (F.abs(finite) < float("inf"))
    )
    centre = CENTRE_NOISE * F.greatest(F.abs("cx"), F.abs("cy"))
    axes = moments.select(
        group, "n", "cx", "cy",
        _flatten((a + c) / 2 + half_gap, centre * centre).alias("major"),
        _flatten((a + c) / 2 - half_gap, FLAT * (a + c) + centre * centre).alias("minor"),
        F.degrees(F.atan2(2 * b + 0.0, a - c) / 2).alias("tilt"),
    )
    return axes.select(
        group, "n", "cx", "cy", "major", "minor",
        (2 * n_sd * F.sqrt("major")).alias("width"),
        (2 * n_sd * F.sqrt("minor")).alias("height"),
        F.when(F.col("major") == 0, 0.0).otherwise(F.col("tilt")).alias("angle"),
        (F.col("minor") == 0).alias("degenerate"),
    )


def _flatten(value: Column, noise: Column) -> Column:
    """An eigenvalue, or 0 where it doesn't exceed the noise; rounding may leave it below 0."""
    return F.when(value <= noise, 0.0).otherwise(value)


def group_ordinals(
    df: DataFrame, group: str, row_id: str, cycle: int = PALETTE, few_groups: bool = False
) -> DataFrame:
    """Distinct non-null groups in order of first appearance, with a cyclic ordinal.

    ``(group, first_row, ordinal, colour)``. Groups are ranked by ranges of
    their first rows, so any column will do. ``few_groups`` ranks them in
    one task instead, for labels, of which a dictionary has a bounded number.
    """
    first = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(row_id).alias("first_row"))
    if few_groups:
        ordinal = (F.row_number().over(Window.orderBy("first_row")) - 1).cast("bigint")
        ranked = first.withColumn("ordinal", ordinal)
    else:
        ranked = row_numbers(first, "first_row", "ordinal")
    return ranked.withColumn("colour", F.col("ordinal") % cycle)

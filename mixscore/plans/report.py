"""The five result tables and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixscore.functions.scalars import component_name, with_default
from mixscore.functions.text import quoted
from mixscore.operators.decide import weight_table
from mixscore.operators.pca import loadings_wide, variance_frame
from mixscore.plans.model import ProfileModel, fit_profile_pca, fitted_rows
from mixscore.sources.dictionary import DISPLAY_LABELS
from mixscore.sources.measurements import require_columns

# Pass-through columns of the score table and their output names.
PASS_THROUGH = {
    "Quantum yield(%)": "Quantum_yield(%)",
    "Ex(nm)": "Ex(nm)",
    "Em(nm)": "Em(nm)",
    "particle size(nm)": "particle_size(nm)",
    "stoke (nm)": "stoke(nm)",
}


def score_table(model: ProfileModel, rows: DataFrame | None = None) -> DataFrame:
    """Name, raw and main solvent, PC1..PC3 and the measured quantities, keyed by row id."""
    require_columns(model.measurements, ["Name", model.solvent, *PASS_THROUGH])
    rows = fitted_rows(model) if rows is None else rows
    third = F.col("Solvent_PC3") if model.fit.k > 2 else F.lit(None).cast("double")
    return rows.select(
        F.col(quoted(model.row_id)).alias("row_id"),
        F.col("Name"),
        F.col(quoted(model.solvent)).alias("Solvent_Original"),
        F.col("Solvent_Main"),
        F.col("Solvent_PC1").alias("PC1"),
        F.col("Solvent_PC2").alias("PC2"),
        third.alias("PC3"),
        *[F.col(quoted(c)).alias(name) for c, name in PASS_THROUGH.items()],
    )


def variance_table(variance: DataFrame, k: int = 10) -> DataFrame:
    """Ratios and percentages of the first ``k`` components."""
    return (
        variance.where(F.col("component") <= k)
        .orderBy("component")
        .select(
            component_name(F.col("component")).alias("Principal Component"),
            F.col("ratio").alias("Explained Variance Ratio"),
            (F.col("ratio") * 100).alias("Explained Variance (%)"),
            F.col("cumulative").alias("Cumulative Variance Ratio"),
            (F.col("cumulative") * 100).alias("Cumulative Variance (%)"),
        )
    )


def loadings_table(model: ProfileModel, k: int = 5, labels: dict[str, str] = DISPLAY_LABELS) -> DataFrame:
    """Property labels as rows, the first ``k`` components as columns."""
    return labelled(loadings_wide(model.measurements.sparkSession, model.fit, k), labels)


def labelled(wide: DataFrame, labels: dict[str, str]) -> DataFrame:
    named = wide.orderBy("ord").withColumn("Property", with_default(labels, F.col("feature")))
    return named.select("Property", *[c for c in wide.columns if c not in ("ord", "feature")])


def feature_weight_table(model: ProfileModel, labels: dict[str, str] = DISPLAY_LABELS) -> DataFrame:
    """Property labels and the weights used."""
    table = weight_table(model.measurements.sparkSession, model.weights, labels)
    return table.orderBy("ord").select(F.col("label").alias("Property"), F.col("weight").alias("Weight"))


def report_tables(
    model: ProfileModel, labels: dict[str, str] = DISPLAY_LABELS, rows: DataFrame | None = None
) -> dict[str, DataFrame]:
    """All five tables by name; ``rows`` may hold the scored rows already written."""
    rows = fitted_rows(model) if rows is None else rows
    return {
        "enriched": rows,
        "plot_data": score_table(model, rows),
        "variance": variance_table(variance_frame(model.measurements.sparkSession, model.fit)),
        "loadings": loadings_table(model, labels=labels),
        "feature_weights": feature_weight_table(model, labels),
    }


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Write each table under ``folder``; returns the paths."""
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in tables}
    for name, table in tables.items():
        writer = table.write.mode("overwrite").format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(paths[name])
    return paths


def run(measurements: DataFrame, folder: str, fmt: str = "parquet", **options) -> ProfileModel:
    """Fit the analysis on a measurement table and write its five tables.

    ``model.release()`` frees its reduced table. In a columnar format the enriched rows are written first and the score
    table is read back from them, so every row is scored once.
    """
    require_columns(measurements, ["Name", *PASS_THROUGH])
    model = fit_profile_pca(measurements, **options)
    rows = fitted_rows(model)
    path = write_tables({"enriched": rows}, folder, fmt)["enriched"]
    if fmt in ("parquet", "orc"):
        rows = measurements.sparkSession.read.schema(rows.schema).format(fmt).load(path)
    tables = report_tables(model, rows=rows)
    del tables["enriched"]
    write_tables(tables, folder, fmt)
    return model

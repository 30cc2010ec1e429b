import pytest
from pyspark.sql import functions as F

from conftest import measurement_frame
from mixscore.operators.shape import shape_report
from mixscore.plans import charts, fit_profile_pca, report, report_tables, run
from mixscore.sources.dictionary import DISPLAY_LABELS, FEATURES, labels_frame, weights_frame

PLOT = [
    "row_id", "Name", "Solvent_Original", "Solvent_Main", "PC1", "PC2", "PC3",
    "Quantum_yield(%)", "Ex(nm)", "Em(nm)", "particle_size(nm)", "stoke(nm)",
]


def test_five_tables(part_measurements, part_model):
    tables = report_tables(part_model)
    assert list(tables) == ["enriched", "plot_data", "variance", "loadings", "feature_weights"]
    assert tables["plot_data"].columns == PLOT
    assert tables["variance"].columns == [
        "Principal Component", "Explained Variance Ratio", "Explained Variance (%)",
        "Cumulative Variance Ratio", "Cumulative Variance (%)",
    ]
    assert [r[0] for r in tables["variance"].collect()] == [f"PC{i}" for i in range(1, 11)]
    assert tables["loadings"].columns == ["Property", "PC1", "PC2", "PC3", "PC4", "PC5"]
    labels = [DISPLAY_LABELS[f] for f in FEATURES]
    assert [r[0] for r in tables["loadings"].collect()] == labels
    assert [r[0] for r in tables["feature_weights"].collect()] == labels
    assert tables["enriched"].columns == [
        *part_measurements.columns, "Solvent_PC1", "Solvent_PC2", "Solvent_PC3", "Solvent_Main"
    ]
    raw = {r["row_id"]: r["Solvent"] for r in part_measurements.collect()}
    assert {r["row_id"]: r["Solvent_Original"] for r in tables["plot_data"].collect()} == raw


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv"])
def test_run_writes_all_tables(spark, tmp_path, fmt):
    df = measurement_frame(spark, ["Water", "DMF/THF", None, "Toluene", "DMSO", "acetone"] * 3).withColumn("extra", F.lit("kept"))
    model = run(df, str(tmp_path), fmt)
    reader = spark.read.option("header", True)
    back = {name: reader.format(fmt).load(f"{tmp_path}/{name}") for name in report_tables(model)}
    assert {n: t.count() for n, t in back.items()} == {
        "plot_data": 18, "variance": 10, "loadings": 15, "feature_weights": 15, "enriched": 18
    }
    assert back["plot_data"].columns == PLOT
    assert back["enriched"].where("extra = 'kept'").count() == 18


def test_plot_data_needs_its_columns(spark, tmp_path):
    df = measurement_frame(spark, ["Water", "DMF", "THF"]).drop("Em(nm)", "stoke (nm)")
    with pytest.raises(ValueError, match=r"Em\(nm\), stoke \(nm\)"):
        run(df, str(tmp_path))
    with pytest.raises(ValueError, match=r"Em\(nm\)"):
        report.score_table(fit_profile_pca(df))


def test_two_rows_leave_pc3_empty(spark):
    table = report.score_table(fit_profile_pca(measurement_frame(spark, ["Water", "DMF"])))
    assert table.columns == PLOT
    assert {r["PC3"] for r in table.collect()} == {None}


def test_charts_hold_every_row(part_measurements, part_model):
    n = part_measurements.count()
    for points in (charts.score_points, charts.score_points_3d, charts.biplot_points):
        assert points(part_model).count() == n
    colours = {r["Solvent_Main"]: r["colour"] for r in charts.label_ordinals(part_model).collect()}
    assert colours["Water"] == 0 and colours["Ethanol"] == 1
    shown = {(r["Solvent_Main"], r["colour"]) for r in charts.score_points(part_model).collect()}
    assert shown == set(colours.items())


def test_biplot_extent_is_the_largest_score(part_model):
    points = charts.biplot_points(part_model).agg(F.max(F.abs("PC1")), F.max(F.abs("PC2"))).first()
    assert charts.score_extent(part_model) == pytest.approx(points[:])


def test_weight_bars_are_sorted_and_flagged(part_model):
    rows = charts.weight_bars(part_model).collect()
    keys = [(r["weight"], r["weight_text"]) for r in rows]
    assert keys == sorted(keys) and keys[0] == (0.3, "0.30")
    # Two features weigh 0.5: the property name decides.
    assert [r["label"] for r in rows if r["weight"] == 0.5] == [DISPLAY_LABELS["density"], DISPLAY_LABELS["ri"]]
    assert sum(r["below_median"] for r in rows) == 7


def test_small_dimensions(spark):
    assert [r["property"] for r in weights_frame(spark).orderBy("ord").collect()] == list(FEATURES)
    assert {r["property"]: r["label"] for r in labels_frame(spark).collect()} == DISPLAY_LABELS


def test_shape_report(spark, part_measurements):
    rows = {r["name"]: (r["n_rows"], r["n_columns"]) for r in shape_report({"m": part_measurements, "e": spark.range(0)}).collect()}
    assert rows == {"m": (200, 8), "e": (0, 1)}


def test_summary_charts_are_small_and_complete(part_model):
    tables = charts.summary_charts(part_model)
    sizes = {name: table.count() for name, table in tables.items()}
    assert sizes == {
        "scree": 15, "variance_percent": 10, "headline": 1, "axis_labels": 3, "label_colours": 11,
        "label_ellipses": 11, "loading_arrows": 15, "loadings_heatmap": 15, "cumulative_curve": 15,
        "weight_bars": 15, "eigenvalue_bars": 15, "biplot_arrows": 15,
    }
    ratio = part_model.fit.ratio
    assert [r["axis_label"] for r in tables["axis_labels"].orderBy("component").collect()] == [
        f"PC{j + 1} ({ratio[j] * 100:.1f}%)" for j in range(3)
    ]
    row = tables["headline"].first()
    assert (row["pc1_text"], row["pc12_text"]) == (f"{ratio[0] * 100:.2f}", f"{(ratio[0] + ratio[1]) * 100:.2f}")

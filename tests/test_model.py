import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import measurement_frame, plan_text
from mixscore.operators.pca import project, variance_frame
from mixscore.plans import charts, distinct_profiles, enrich, fit_profile_pca, fitted_rows, score_rows
from mixscore.sources.dictionary import FEATURES, INITIAL_WEIGHTS, SOLVENTS, PropertyDictionary

SCORES = ["Solvent_PC1", "Solvent_PC2", "Solvent_PC3", "Solvent_Main"]


def test_golden_values(part_model):
    fit = part_model.fit
    # Golden ratios hold for equal shares of the 16 texts; 200 rows are 12.5 of each.
    assert fit.rank == 9 and fit.k == 15
    assert part_model.search_needed is True
    assert part_model.weights == INITIAL_WEIGHTS


def test_golden_values_at_equal_shares(spark):
    from mixscore_checks.views import SOLVENT_TEXTS

    fit = fit_profile_pca(measurement_frame(spark, [s or None for s in SOLVENT_TEXTS] * 125)).fit
    assert fit.ratio[:9] == pytest.approx(
        [0.489595, 0.276182, 0.102714, 0.067341, 0.039992, 0.012610, 0.005903, 0.004151, 0.001512], abs=1e-6
    )
    assert fit.eigenvalues[:4] == pytest.approx([7.347597, 4.144801, 1.541486, 1.010616], abs=1e-6)


def test_golden_groups(spark):
    from mixscore_checks.views import measurements

    model = fit_profile_pca(measurements(spark, "/root/testdata/sf0.01"), search=False)
    assert model.fit.eigenvalues[:4] == pytest.approx([7.347597, 4.144801, 1.541486, 1.010616], abs=1e-6)
    rows = {r["Solvent_Main"]: r for r in charts.label_ellipses(model).collect()}
    assert {k: r["n"] for k, r in rows.items()} == {
        "Water": 375, "Ethanol": 250, "Other": 250, "THF": 250,
        **{k: 125 for k in ("DMF", "DMSO", "Acetone", "Acetonitrile", "Acetic_acid", "Ethyl_acetate", "Pyridine")},
    }
    water = rows.pop("Water")
    assert (water["major"], water["minor"]) == pytest.approx((1.896287, 0.410397), abs=1e-6)
    assert water["angle"] == pytest.approx(-39.1797, abs=1e-4)
    assert all(r["degenerate"] and r["width"] == r["height"] == 0 for r in rows.values())


def test_profiles_hold_every_row_once(part_measurements, part_model):
    total = part_model.profiles.agg(F.sum("n_rows"), F.count("*"), F.min("first_row")).first()
    # 16 texts: 'methanol' falls to Ethanol, 'Toluene' and the missing text to the default.
    assert total[:] == (part_measurements.count(), 14, 0)


def test_spellings_of_one_combination_are_one_profile(spark):
    texts = ["water 1", "WATER", "heavy water", "DMF/Water", "water/dmf", "x/DMF/water 2", "Water/Water/DMF", "?", None]
    got = {(r["Solvent_Main"], r["eps"]): (r["n_rows"], r["first_row"]) for r in distinct_profiles(measurement_frame(spark, texts)).collect()}
    mixed, double = (80.1 + 38.25) / 2, (2 * 80.1 + 38.25) / 3
    assert got == {
        ("Water", 80.1): (3, 0), ("Water", mixed): (3, 3), ("Water", double): (1, 6), ("Other", 80.1): (2, 7)
    }


def test_fit_agrees_with_the_unreduced_rows(part_measurements, part_model):
    from mixscore.operators.pca import fit_pca

    full = fit_pca(enrich(part_measurements), FEATURES)
    assert full.eigenvalues == pytest.approx(part_model.fit.eigenvalues, abs=1e-10)
    assert full.loadings[:, :9] == pytest.approx(part_model.fit.loadings[:, :9], abs=1e-8)


def test_row_scores_equal_projected_profiles(part_measurements, part_model):
    scored = fitted_rows(part_model)
    assert scored.columns == [*part_measurements.columns, *SCORES]
    profiles = project(enrich(part_measurements), part_model.fit, 3, prefix="Solvent_PC")
    a = scored.orderBy("row_id").select("row_id", *SCORES).toPandas()
    b = profiles.orderBy("row_id").select("row_id", *SCORES).toPandas()
    assert a[["row_id", "Solvent_Main"]].equals(b[["row_id", "Solvent_Main"]])
    assert np.abs(a[SCORES[:3]].to_numpy() - b[SCORES[:3]].to_numpy()).max() < 1e-12


def test_scoring_neither_joins_nor_shuffles(part_model):
    plan = plan_text(fitted_rows(part_model))
    for node in ("Join", "Exchange", "Sort ", "Python"):
        assert node not in plan


def test_reducing_shuffles_matched_keys_only(spark, part_measurements, tmp_path):
    path = str(tmp_path / "m")
    part_measurements.write.parquet(path)
    plan = plan_text(distinct_profiles(spark.read.parquet(path)))
    assert "ReadSchema: struct<row_id:bigint,Solvent:string>" in plan
    # One exchange, and neither the text nor its lower-case form is among its columns.
    assert plan.count("Exchange") == 1 and "partial_count" in plan
    exchange = next(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert "Solvent" not in exchange and "lowered" not in exchange
    assert "Python" not in plan and "Window" not in plan


def test_a_third_of_all_rows_on_one_text(spark):
    texts = ["DMF/Water"] * 400 + [f"Ethanol {i}" for i in range(400)] + ["THF", None, "x/y", "DMSO"] * 100
    df = measurement_frame(spark, texts).repartition(6)
    model = fit_profile_pca(df)
    rows = fitted_rows(model)
    assert rows.count() == len(texts)
    counts = {r["Solvent_Main"]: r["count"] for r in rows.groupBy("Solvent_Main").count().collect()}
    assert counts == {"Water": 400, "Ethanol": 400, "THF": 100, "Other": 200, "DMSO": 100}
    ellipses = {r["Solvent_Main"]: r["n"] for r in charts.label_ellipses(model).collect()}
    assert ellipses == counts


def test_scoring_new_texts(spark, part_model):
    new = measurement_frame(spark, ["Acetone/THF", "never seen", None, "Pyridine"])
    got = {r["Solvent"]: r for r in score_rows(new, part_model).collect()}
    known = {r["Solvent_Main"]: r for r in part_model.scored_profiles().collect()}
    assert got["Pyridine"]["Solvent_PC1"] == pytest.approx(known["Pyridine"]["PC1"])
    assert got["never seen"]["Solvent_Main"] == "Other" == got[None]["Solvent_Main"]
    assert got["never seen"]["Solvent_PC2"] == pytest.approx(known["Other"]["PC2"])
    middle = (known["Acetone"]["PC3"] + known["THF"]["PC3"]) / 2
    assert got["Acetone/THF"]["Solvent_PC3"] == pytest.approx(middle)


def test_three_solvents_have_two_components(spark):
    model = fit_profile_pca(measurement_frame(spark, ["Water", "Ethanol", "DMF"]))
    assert (model.fit.k, model.fit.rank) == (3, 2)
    assert model.fit.ratio[0] == pytest.approx(0.565946, abs=1e-6)
    assert model.fit.cumulative[1] == pytest.approx(1.0)
    assert model.search_needed is False
    assert [r["Solvent_PC3"] for r in fitted_rows(model).collect()] == [0.0] * 3


def test_two_rows_have_no_third_score(spark):
    model = fit_profile_pca(measurement_frame(spark, ["Water", "DMF"]))
    assert "Solvent_PC3" not in fitted_rows(model).columns
    assert "Solvent_PC3" not in score_rows(model.measurements, model).columns
    with pytest.raises(ValueError, match="three components"):
        charts.score_points_3d(model)


def test_rows_all_alike(spark):
    model = fit_profile_pca(measurement_frame(spark, ["Water"] * 5))
    assert model.search_needed is False
    assert {r["ratio"] for r in variance_frame(spark, model.fit).collect()} == {None}
    assert {r["Solvent_PC1"] for r in fitted_rows(model).collect()} == {0.0}


def test_own_dictionary_columns_and_names(spark):
    d = PropertyDictionary.from_rows(("p", "q", "r"), [("oak", 1, 2, 9), ("elm", 4, None, 3), ("fir", 2, 8, 1)], "fir")
    df = spark.createDataFrame(
        [(10, "Oak", 1), (11, "elm/oak", 2), (12, "FIR", 3), (13, "yew", 4)], "key long, `my wood` string, p int"
    )
    model = fit_profile_pca(
        df, dictionary=d, features=("q", "r", "p", "absent"), initial_weights={"q": 1, "r": 2, "p": 3},
        solvent="my wood", row_id="key",
    )
    assert model.fit.features == ("q", "r", "p")
    rows = fitted_rows(model).orderBy("key")
    assert rows.columns == ["key", "my wood", "p", *SCORES]
    # 'elm/oak' lacks q, which is imputed by the mean of the other three rows.
    data = np.array([[2, 9, 1], [6, 6, 2.5], [8, 1, 2], [8, 1, 2]])
    assert model.fit.moments.mean == pytest.approx(data.mean(axis=0))
    z = (data - data.mean(axis=0)) / data.std(axis=0)
    scores = np.array(rows.select(*SCORES[:3]).collect())
    assert scores[:, :2] == pytest.approx(z @ model.fit.loadings[:, :2], abs=1e-9)
    assert [r["p"] for r in rows.collect()] == [1, 2, 3, 4]


def test_missing_input_columns_are_named(spark):
    with pytest.raises(ValueError, match="Solvent"):
        fit_profile_pca(spark.range(3).withColumnRenamed("id", "row_id"))


def test_dictionary_frame_is_ordered(spark):
    rows = SOLVENTS.frame(spark).orderBy("ord").collect()
    assert [r["key"] for r in rows] == list(SOLVENTS.keys)
    assert rows[9]["ri"] == 1.509


def test_enriching_twice_replaces_the_results(spark, part_model):
    once = fitted_rows(part_model).withColumn("__extra", F.lit(1)).withColumn("_first", F.col("row_id"))
    again = score_rows(once.withColumn("Solvent_PC1", F.lit(9.0)), part_model)
    assert sorted(again.columns) == sorted(once.columns)
    a = again.orderBy("row_id").select("row_id", "_first", *SCORES).collect()
    b = once.orderBy("row_id").select("row_id", "row_id", *SCORES).collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["Water", "DMF", "THF/DMF", None])], "`row.id` long, `the solvent` string")
    model = fit_profile_pca(df, solvent="the solvent", row_id="row.id")
    assert fitted_rows(model).columns == ["row.id", "the solvent", *SCORES]
    assert charts.score_points(model).count() == 4
    assert [r["Solvent_Main"] for r in charts.label_ordinals(model).orderBy("ordinal").collect()] == ["Water", "DMF", "Other"]

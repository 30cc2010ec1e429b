import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mixscore.functions.scalars import component_name, fixed_text, floor_weight, vector_norm, with_default
from mixscore.operators import decide
from mixscore.operators.moments import Moments
from mixscore.operators.pca import pca_of_moments, variance_frame
from mixscore.sources.dictionary import FEATURES, INITIAL_WEIGHTS, SOLVENTS
from mixscore.sources.shared import small_frame


def fit_of(corr, n=50):
    corr = np.array(corr, dtype=float)
    return pca_of_moments(Moments(tuple("abcdefgh"[: len(corr)]), n, np.zeros(len(corr)), corr))


def dictionary_moments():
    """Moments of one row per dictionary key, features on their own scales."""
    data = np.array([[SOLVENTS.values(f)[i] for f in FEATURES] for i in range(len(SOLVENTS.keys))])
    return Moments(FEATURES, len(data), data.mean(axis=0), np.cov(data.T, bias=True))


@pytest.mark.parametrize(
    "corr, needed, n_to",
    [
        ([[1, 0.9, 0], [0.9, 1, 0], [0, 0, 1]], False, 2),
        (np.eye(3), True, 3),
        ([[1, 0.95], [0.95, 1]], False, 1),
        (np.zeros((3, 3)), False, 3),
    ],
)
def test_decision(spark, corr, needed, n_to):
    fit = fit_of(corr)
    assert decide.search_needed(fit) is needed
    assert decide.components_to(fit) == n_to
    row = decide.decision(variance_frame(spark, fit)).first()
    assert (row["search_needed"], row["n_to_threshold"]) == (needed, n_to)
    if not np.isnan(fit.ratio[0]):
        assert (row["pc1_pct"], row["pc12_pct"]) == pytest.approx((100 * fit.ratio[0], 100 * fit.cumulative[1]))


def test_candidates_follow_the_rule(spark):
    initial = {"a": 1.0, "b": 0.05, "c": 2.0}
    rows = {r["cand_id"]: r["weights"] for r in decide.candidate_weights(spark, initial, n=200).collect()}
    assert rows[0] == [1.0, 0.1, 2.0]
    assert rows[1] == [1.05, 0.1, 2.0]
    assert rows[2] == pytest.approx([1.0, 0.1, 2.0])
    assert rows[3] == [1.0, 0.1, 2.1]
    rest = np.array([rows[i] for i in range(4, 200)])
    assert (rest >= 0.1).all() and (rest < 5).all() and len(np.unique(rest)) > 500


def test_flat_objective_keeps_the_initial_weights(spark):
    m = dictionary_moments()
    swept = decide.sweep_weights(decide.candidate_weights(spark, INITIAL_WEIGHTS), m).cache()
    assert swept.count() == decide.CANDIDATES
    spread = swept.agg((F.max("objective") - F.min("objective")).alias("s")).first()["s"]
    assert spread < 1e-12
    best = decide.best_candidate(swept).first()
    assert best["cand_id"] == 0
    assert best["cum2"] == pytest.approx(pca_of_moments(m).cumulative[1])
    swept.unpersist()


def test_lowest_distance_wins_when_it_differs(spark):
    swept = spark.createDataFrame(
        [(0, [1.0], 0.7, 0.15), (1, [2.0], 0.8, 0.05), (2, [3.0], 0.8, 0.05 - 1e-12)],
        "cand_id long, weights array<double>, cum2 double, objective double",
    )
    assert decide.best_candidate(swept).first()["cand_id"] == 1


def test_initial_weights_stay_at_rounding_edges_of_the_threshold(spark):
    m = dictionary_moments()
    share = pca_of_moments(m).cumulative[1]
    candidates = decide.candidate_weights(spark, INITIAL_WEIGHTS, n=300)
    for step in (0.0840000005, 0.0840000015, 0.0840000025, 0.0, 5e-10):
        swept = decide.sweep_weights(candidates, m, threshold=share + step)
        assert decide.best_candidate(swept).first()["cand_id"] == 0


def test_a_tie_goes_to_the_lowest_id(spark):
    rows = [(0, [1.0], 0.7, 0.1 + 2e-9), (1, [2.0], 0.8, 0.1 + 5e-10), (2, [3.0], 0.8, 0.1)]
    swept = spark.createDataFrame(rows, "cand_id long, weights array<double>, cum2 double, objective double")
    assert decide.best_candidate(swept).first()["cand_id"] == 1


def test_used_weights_are_the_initial_ones_at_or_above_the_threshold(spark):
    assert decide.used_weights(spark, fit_of([[1, 0.95], [0.95, 1]]), {"a": 3.0, "b": 0.01}) == {"a": 3.0, "b": 0.01}
    # Below it the floor applies.
    assert decide.used_weights(spark, fit_of(np.eye(3)), {"a": 3.0, "b": 0.01, "c": 1.0}) == {"a": 3.0, "b": 0.1, "c": 1.0}


def test_kaiser(spark):
    rows = decide.kaiser(variance_frame(spark, fit_of([[1, 0.5], [0.5, 1]]))).orderBy("component").collect()
    assert [r["kaiser"] for r in rows] == [True, False]


def test_median_and_quantile_flags_agree_with_numpy(spark):
    values = [0.4, 0.1, 0.9, 0.35, 0.7, 0.2]
    df = small_frame(spark, [(i, v) for i, v in enumerate(values)], pa.schema([("i", pa.int32()), ("v", pa.float64())]))
    below = [r["below_median"] for r in decide.flag_below_median(df, F.col("v")).orderBy("i").collect()]
    assert below == [v < np.median(values) for v in values]
    strong = [r["is_strong"] for r in decide.flag_strong(df, F.col("v")).orderBy("i").collect()]
    assert strong == [v >= np.quantile(values, 0.67) for v in values]


def test_scalars(spark):
    df = spark.createDataFrame([("a", 3, 3.0, -4.0, 0.05), ("z", 1, float("nan"), 1.0, 0.5)], "k string, i int, x double, y double, w double")
    rows = df.select(
        with_default({"a": "Alpha"}, F.col("k")),
        component_name(F.col("i")),
        vector_norm(F.col("x"), F.col("y")),
        floor_weight(F.col("w")),
        with_default({}, F.col("k")),
    ).collect()
    assert rows[0][:] == ("Alpha", "PC3", 5.0, 0.1, "a")
    assert (rows[1][0], rows[1][1], rows[1][3], rows[1][4]) == ("z", "PC1", 0.5, "z")


@pytest.mark.parametrize("value", [0.25, 2.675, 1.005, -0.04, 12.35, 0.125, 71.25, 48.959487, 0.0, 1234567.891])
def test_fixed_text_rounds_like_python(spark, value):
    row = spark.range(1).select(fixed_text(F.lit(value), 1), fixed_text(F.lit(value), 2)).first()
    assert row[:] == (f"{value:.1f}", f"{value:.2f}")

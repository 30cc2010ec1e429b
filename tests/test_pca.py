import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mixscore.operators.moments import Moments
from mixscore.operators.pca import (
    fit_pca,
    loadings_frame,
    loadings_wide,
    pca_of_moments,
    project,
    variance_frame,
)
from mixscore.operators.prepare import weight_features


def frame(spark, data):
    names = [f"f{i}" for i in range(data.shape[1])]
    rows = [(i, *map(float, r)) for i, r in enumerate(data)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names)), names


def numpy_pca(data):
    """Singular values of the standardised matrix, signs by the largest loading."""
    sd = data.std(axis=0)
    z = np.where(sd > 0, (data - data.mean(axis=0)) / np.where(sd > 0, sd, 1), 0.0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    vt = vt * np.sign(vt[range(len(vt)), np.abs(vt).argmax(axis=1)])[:, None]
    return s**2 / (len(data) - 1), vt.T, z @ vt.T


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    return rng.normal(size=(120, 5)) @ rng.normal(size=(5, 5)) + 10


def test_fit_and_scores_agree_with_svd(spark, data):
    df, names = frame(spark, data)
    fit = fit_pca(df, names)
    eigenvalues, loadings, scores = numpy_pca(data)
    assert fit.eigenvalues == pytest.approx(eigenvalues)
    assert fit.ratio == pytest.approx(eigenvalues / eigenvalues.sum())
    assert fit.loadings == pytest.approx(loadings, abs=1e-9)
    got = project(df, fit, 5).orderBy("id").select(*[f"PC{j}" for j in range(1, 6)]).collect()
    assert np.array(got) == pytest.approx(scores, abs=1e-9)


def test_invariants(spark, data):
    df, names = frame(spark, data)
    fit = fit_pca(df, names)
    n, p = data.shape
    assert fit.eigenvalues.sum() == pytest.approx(p * n / (n - 1))
    assert fit.loadings.T @ fit.loadings == pytest.approx(np.eye(p), abs=1e-12)
    residual = fit.moments.correlation @ fit.loadings - fit.loadings * fit.eigenvalues * (n - 1) / n
    assert np.abs(residual).max() < 1e-9
    means = project(df, fit, p).agg(*[F.avg(f"PC{j}") for j in range(1, p + 1)]).first()
    assert np.abs(np.array(means)).max() < 1e-9


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(weights=st.lists(st.floats(0.1, 5), min_size=5, max_size=5))
def test_positive_weights_change_nothing(spark, data, weights):
    df, names = frame(spark, data)
    weighted = weight_features(df, dict(zip(names, weights)))
    plain, other = fit_pca(df, names), fit_pca(weighted, names)
    assert other.eigenvalues == pytest.approx(plain.eigenvalues)
    assert other.loadings == pytest.approx(plain.loadings, abs=1e-9)
    a = project(df, plain, 3).select("id", "PC1", "PC2", "PC3").orderBy("id").collect()
    b = project(weighted, other, 3).select("id", "PC1", "PC2", "PC3").orderBy("id").collect()
    assert np.array(a) == pytest.approx(np.array(b), abs=1e-9)


def test_row_order_and_partitioning_change_nothing(spark, data):
    df, names = frame(spark, data)
    shuffled = fit_pca(df.orderBy(F.rand(5)).repartition(7), names)
    plain = fit_pca(df.coalesce(1), names)
    assert shuffled.eigenvalues == pytest.approx(plain.eigenvalues, abs=1e-12)
    assert shuffled.loadings == pytest.approx(plain.loadings, abs=1e-10)


def test_fewer_rows_than_features(spark):
    data = np.random.default_rng(2).normal(size=(3, 5))
    df, names = frame(spark, data)
    fit = fit_pca(df, names)
    eigenvalues, loadings, _ = numpy_pca(data)
    assert (fit.k, fit.rank) == (3, 2)
    assert fit.eigenvalues == pytest.approx(eigenvalues, abs=1e-9)
    assert fit.loadings[:, :2] == pytest.approx(loadings[:, :2], abs=1e-9)
    assert np.isnan(fit.loadings[:, 2]).all()
    assert [r["PC3"] for r in project(df, fit, 3).collect()] == [0.0] * 3
    assert loadings_frame(spark, fit).where("component = 3 and loading is not null").count() == 0


def test_one_row_is_refused(spark):
    df, names = frame(spark, np.ones((1, 3)))
    with pytest.raises(ValueError, match="two rows"):
        fit_pca(df, names)


def test_identical_rows_have_no_ratio(spark):
    df, names = frame(spark, np.full((4, 3), 0.1))
    fit = fit_pca(df, names)
    rows = variance_frame(spark, fit).orderBy("component").collect()
    assert [tuple(r) for r in rows] == [(i, 0.0, None, None) for i in (1, 2, 3)]
    assert {tuple(r)[-2:] for r in project(df, fit, 2).collect()} == {(0.0, 0.0)}


def test_constant_column_has_no_part(spark, data):
    wide = np.column_stack([data, np.full(len(data), 0.3)])
    df, names = frame(spark, wide)
    fit = fit_pca(df, names)
    eigenvalues, _, scores = numpy_pca(data)
    assert (fit.k, fit.rank) == (6, 5)
    assert fit.eigenvalues[:5] == pytest.approx(eigenvalues)
    assert fit.ratio.sum() == pytest.approx(1.0)
    assert np.abs(fit.loadings[5, :5]).max() < 1e-12
    got = project(df, fit, 2).orderBy("id").select("PC1", "PC2").collect()
    assert np.array(got) == pytest.approx(scores[:, :2], abs=1e-9)


def test_two_features_have_no_third_component(spark, data):
    df, names = frame(spark, data[:, :2])
    fit = fit_pca(df, names)
    assert fit.k == 2
    assert {r["PC3"] for r in project(df, fit, 3).collect()} == {None}
    # Both loadings have the same size: the first feature decides the sign.
    assert (fit.loadings[0] > 0).all()


def test_missing_values_count_as_the_mean(spark, data):
    holes = data.copy()
    holes[::7, 1] = np.nan
    filled = np.where(np.isnan(holes), np.nanmean(holes, axis=0), holes)
    df, names = frame(spark, holes)
    eigenvalues, _, scores = numpy_pca(filled)
    fit = fit_pca(df, names)
    assert fit.eigenvalues == pytest.approx(eigenvalues)
    got = project(df, fit, 1).orderBy("id").select("PC1").collect()
    assert np.array(got)[:, 0] == pytest.approx(scores[:, 0], abs=1e-9)


def test_weighted_rows_equal_repeated_rows(spark, data):
    df, names = frame(spark, data[:30])
    weighted = df.withColumn("w", (F.col("id") % 4 + 1).cast("int"))
    repeated = weighted.withColumn("i", F.explode(F.sequence(F.lit(1), "w")))
    a, b = fit_pca(weighted, names, weight="w"), fit_pca(repeated, names)
    assert a.moments.n == b.moments.n
    assert a.eigenvalues == pytest.approx(b.eigenvalues)
    assert a.loadings == pytest.approx(b.loadings, abs=1e-9)


def test_tables(spark, data):
    df, names = frame(spark, data)
    fit = fit_pca(df, names)
    rows = variance_frame(spark, fit).orderBy("component").collect()
    assert [r["cumulative"] for r in rows] == pytest.approx(np.cumsum(fit.ratio))
    wide = loadings_wide(spark, fit, 2).orderBy("ord").collect()
    assert np.array([[r["PC1"], r["PC2"]] for r in wide]) == pytest.approx(fit.loadings[:, :2])
    assert [r["feature"] for r in wide] == names


def test_eigenvalue_divisors():
    m = Moments(("a", "b"), 11, np.zeros(2), np.array([[1.0, 0.5], [0.5, 1.0]]))
    assert pca_of_moments(m).eigenvalues == pytest.approx([1.65, 0.55])

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixscore.operators import moments as moments_module
from mixscore.operators.moments import correlation_frame, moments
from mixscore.operators.prepare import (
    available_features,
    column_stats,
    impute_mean,
    standardise,
    weight_features,
)

NAN = float("nan")
ROWS = [(1, 1.0, None, 7.0), (2, NAN, 4.0, 7.0), (3, 3.0, 8.0, 7.0), (4, 8.0, 6.0, 7.0)]


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame(ROWS, "id int, `x y` double, z double, c double")


def test_imputing_skips_null_and_nan(gaps):
    out = impute_mean(gaps, ["x y", "z"]).orderBy("id").collect()
    assert [r["x y"] for r in out] == [1.0, 4.0, 3.0, 8.0]
    assert [r["z"] for r in out] == [6.0, 4.0, 8.0, 6.0]


def test_standardising_uses_the_population_deviation_of_imputed_values(gaps):
    out = standardise(gaps, ["x y", "z", "c"]).orderBy("id").collect()
    x = np.array([1.0, 4.0, 3.0, 8.0])
    assert [r["x y"] for r in out] == pytest.approx((x - x.mean()) / x.std())
    z = np.array([6.0, 4.0, 8.0, 6.0])
    assert [r["z"] for r in out] == pytest.approx((z - z.mean()) / z.std())
    assert [r["c"] for r in out] == [0.0] * 4


def test_constant_columns_are_recognised_exactly(spark):
    df = spark.range(1000).select(F.lit(0.1).alias("a"), (F.lit(0.1) + F.col("id") * 1e-12).alias("b"))
    stats = column_stats(df, ["a", "b"])
    assert stats.constant == (True, False)
    assert stats.mean[0] == 0.1


def test_weighted_statistics_equal_repeated_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3), (5.0, None, 1), (-2.0, 7.0, 4)], "a double, b double, w int")
    repeated = df.withColumn("i", F.explode(F.sequence(F.lit(1), "w")))
    one, many = column_stats(df, ["a", "b"], weight="w"), column_stats(repeated, ["a", "b"])
    assert (one.n, one.present, one.constant) == (many.n, many.present, many.constant) == (8, (8, 7), (False, False))
    assert one.mean == pytest.approx(many.mean)
    assert moments(df, ["a", "b"], "w").covariance == pytest.approx(moments(repeated, ["a", "b"]).covariance)


@pytest.mark.parametrize("bad", [None, float("inf"), -float("inf")])
def test_columns_without_usable_values_are_refused(spark, bad):
    rows = [(bad, 1.0), (bad, 2.0)]
    with pytest.raises(ValueError, match="'a'"):
        column_stats(spark.createDataFrame(rows, "a double, b double"), ["a", "b"])


def test_no_rows_and_no_features_are_refused(spark, gaps):
    with pytest.raises(ValueError):
        column_stats(gaps.where("id > 99"), ["z"])
    with pytest.raises(ValueError):
        column_stats(gaps, [])


def test_feature_selection_and_weighting(gaps):
    assert available_features(gaps, ["z", "nope", "x y"]) == ["z", "x y"]
    out = weight_features(gaps, {"z": 0.5, "c": 2}).orderBy("id").collect()
    assert [r["z"] for r in out] == [None, 2.0, 4.0, 3.0]
    assert [r["c"] for r in out] == [14.0] * 4


@pytest.mark.parametrize("p", [1, 3, 12, 13, 16, 17, 40])
def test_both_moment_forms_agree_with_numpy(spark, p):
    rng = np.random.default_rng(p)
    data = rng.normal(size=(200, p)) * np.logspace(-3, 6, p) + np.logspace(3, 7, p)
    names = [f"f{i}" for i in range(p)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"{n} double" for n in names))
    m = moments(df, names)
    assert m.mean == pytest.approx(data.mean(axis=0), rel=1e-12)
    scale = data.std(axis=0)
    want = np.atleast_2d(np.cov(data.T, bias=True)) / np.outer(scale, scale)
    assert m.covariance / np.outer(scale, scale) == pytest.approx(want, abs=1e-9)
    assert m.correlation == pytest.approx(want, abs=1e-9)


def test_correlation_frame_lists_the_upper_triangle(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 1.0, 5.0), (3.0, 0.0, 5.0)], "a double, b double, c double")
    rows = {(r[0], r[1]): r[2] for r in correlation_frame(spark, moments(df, ["a", "b", "c"])).collect()}
    assert rows == pytest.approx(
        {("a", "a"): 1, ("a", "b"): -1, ("a", "c"): 0, ("b", "b"): 1, ("b", "c"): 0, ("c", "c"): 0}
    )
    assert not any(math.isnan(v) for v in rows.values())


def test_wide_standardising_agrees_with_numpy(spark):
    data = np.random.default_rng(9).normal(size=(60, 30)) * np.arange(1, 31)
    names = [f"f{i}" for i in range(30)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], "id int, " + ", ".join(f"{n} double" for n in names))
    got = np.array(standardise(df, names).orderBy("id").select(*names).collect())
    assert got == pytest.approx((data - data.mean(axis=0)) / data.std(axis=0), abs=1e-9)


def moments_by_hand(columns, weights=None):
    """Means over present values, covariance with gaps on the mean, in double-double by fractions."""
    from fractions import Fraction

    n = len(columns[0])
    weights = weights or [1] * n
    means, centred_columns = [], []
    for column in columns:
        held = [(Fraction(v), w) for v, w in zip(column, weights) if v is not None and v == v]
        mean = sum(v * w for v, w in held) / sum(w for _, w in held)
        means.append(float(mean))
        centred_columns.append([Fraction(v) - mean if v is not None and v == v else Fraction(0) for v in column])
    total = sum(weights)
    cov = [[float(sum(a * b * w for a, b, w in zip(x, y, weights)) / total) for y in centred_columns] for x in centred_columns]
    return means, cov


@pytest.mark.parametrize("p", [3, 9])
@pytest.mark.parametrize("weighted", [False, True])
def test_one_scan_is_exact_far_from_zero_and_with_gaps(spark, monkeypatch, p, weighted):
    rng = np.random.default_rng(p)
    columns = [(1e9 + rng.normal(0, 1, 3000)).tolist() for _ in range(p - 2)]
    columns += [[0.1] * 3000, [None if i % 3 else float(v) if i % 2 else float("nan") for i, v in enumerate(rng.normal(5, 2, 3000))]]
    weights = rng.integers(1, 6, 3000).tolist() if weighted else None
    names = [f"f{i}" for i in range(p)]
    rows = list(zip(*columns, weights or [1] * 3000))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", w int").repartition(4)
    monkeypatch.setattr(moments_module, "_two_scans", None)  # not needed
    m = moments(df, names, "w" if weighted else None)
    means, cov = moments_by_hand(columns, weights)
    assert m.mean == pytest.approx(means, rel=1e-15) and m.covariance == pytest.approx(np.array(cov), rel=1e-9, abs=1e-9)
    assert m.sd[-2] == 0.0 and m.mean[-2] == 0.1 and (m.covariance[-2] == 0).all()
    assert m.n == (sum(weights) if weighted else 3000)


def test_a_guess_far_off_takes_two_scans(spark, monkeypatch):
    monkeypatch.setattr(moments_module, "GUESSED_FROM", 1)
    rows = [(-1e6, 1.0)] + [(1e9 + i % 7 / 8, float(i)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "a double, b double").coalesce(1)
    m = moments(df, ["a", "b"])
    means, cov = moments_by_hand([[r[0] for r in rows], [r[1] for r in rows]])
    assert m.mean == pytest.approx(means) and m.covariance == pytest.approx(np.array(cov), rel=1e-9)
    late = spark.createDataFrame([(None, 1.0), (2.0, 2.0), (4.0, 3.0)], "a double, b double").coalesce(1)
    assert moments(late, ["a", "b"]).mean.tolist() == [3.0, 2.0]
    with pytest.raises(ValueError, match="infinite"):
        moments(spark.createDataFrame([(1.0,), (float("inf"),)], "a double").coalesce(1), ["a"])
    with pytest.raises(ValueError, match="no values"):
        moments(spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double"), ["a", "b"])

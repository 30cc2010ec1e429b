import random

import numpy as np
import pytest
from conftest import plan_text
from pyspark.sql import functions as F

from mixscore.operators.groups import group_ellipse, group_ordinals
from mixscore.operators.ranks import row_numbers


def numpy_ellipse(x, y):
    values, vectors = np.linalg.eigh(np.cov(x, y))
    major = vectors[:, 1]
    return values[1], values[0], np.degrees(np.arctan2(major[1], major[0])) % 180


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    rows = []
    for name, n, shape in (("a", 400, [[2, 1], [0, 1]]), ("b", 20, [[1, -2], [0.3, 1]]), ("c", 3, [[1, 0], [0, 5]])):
        rows += [(name, *map(float, p)) for p in rng.normal(size=(n, 2)) @ np.array(shape) + 7]
    rows += [("two", 1.0, 1.0), ("two", 2.0, 3.0)]
    rows += [("same", 0.1, 0.3)] * 5
    rows += [("line", float(i), 2.0 * i) for i in range(4)]
    rows += [("gap", float("nan"), 1.0)] * 3 + [("far", float("inf"), 1.0)] * 3
    rows += [(None, 1.0, 2.0)] * 4
    return spark.createDataFrame(rows, "g string, x double, y double")


def by_group(df):
    return {r["g"]: r for r in df.collect()}


def test_ellipses_agree_with_numpy(points):
    got = by_group(group_ellipse(points, "g", "x", "y"))
    assert set(got) == {"a", "b", "c", "same", "line"}
    local = points.toPandas()
    for name in ("a", "b", "c", "line"):
        part, row = local[local.g == name], got[name]
        major, minor, angle = numpy_ellipse(part.x, part.y)
        assert (row["n"], row["cx"], row["cy"]) == (len(part), pytest.approx(part.x.mean()), pytest.approx(part.y.mean()))
        assert (row["major"], row["minor"]) == (pytest.approx(major), pytest.approx(minor, abs=1e-11))
        assert row["width"] == pytest.approx(2 * 1.7 * np.sqrt(major))
        assert row["angle"] % 180 == pytest.approx(angle)
        assert -90 < row["angle"] <= 90
        assert row["degenerate"] is (name == "line")


def test_no_group_is_lost_or_flattened_at_any_scale(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(200):
        start, step = rng.uniform(-7e8, 7e8, 2), rng.uniform(-3e7, 3e7, 2)
        rows += [(f"line{i}", *map(float, start + t * step)) for t in rng.integers(0, 50, 20)]
        rows += [(f"small{i}", *map(float, p)) for p in rng.normal(size=(20, 2)) * 1e-7]
        rows += [(f"same{i}", float(start[0]), float(start[1]))] * 5
    got = by_group(group_ellipse(spark.createDataFrame(rows, "g string, x double, y double"), "g", "x", "y"))
    assert len(got) == 600
    assert all(r["degenerate"] and r["minor"] == 0 < r["major"] for g, r in got.items() if g.startswith("line"))
    assert all(r["major"] == 0 for g, r in got.items() if g.startswith("same"))
    local = spark.createDataFrame(rows, "g string, x double, y double").where("g LIKE 'small%'").toPandas()
    for name, part in local.groupby("g"):
        major, minor, _ = numpy_ellipse(part.x, part.y)
        assert not got[name]["degenerate"]
        assert (got[name]["major"], got[name]["minor"]) == (
            pytest.approx(major, rel=1e-9, abs=1e-30), pytest.approx(minor, rel=1e-9, abs=1e-30)
        )


def test_coinciding_points_keep_a_zero_ellipse(points):
    row = by_group(group_ellipse(points, "g", "x", "y"))["same"]
    assert (row["n"], row["major"], row["minor"], row["width"], row["height"], row["angle"]) == (5, 0, 0, 0, 0, 0)
    assert row["degenerate"] is True


def test_weighted_points_equal_repeated_points(points):
    weighted = points.withColumn("w", (F.abs(F.hash("x", "y")) % 4 + 1).cast("long"))
    repeated = weighted.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "w")))
    a, b = by_group(group_ellipse(weighted, "g", "x", "y", weight="w")), by_group(group_ellipse(repeated, "g", "x", "y"))
    assert set(a) == set(b) and a["a"]["n"] > 400
    for name in a:
        for c in ("n", "cx", "cy", "major", "minor", "width"):
            assert a[name][c] == pytest.approx(b[name][c], abs=1e-9), (name, c)
        assert a[name]["angle"] == pytest.approx(b[name]["angle"], abs=1e-7)


def test_a_weight_counts_towards_the_smallest_group(spark):
    df = spark.createDataFrame([("x", 1.0, 1.0, 3), ("y", 1.0, 1.0, 2), ("z", 1.0, 1.0, 1)], "g string, x double, y double, w int")
    assert set(by_group(group_ellipse(df, "g", "x", "y", weight="w"))) == {"x"}


def test_a_circle_and_upright_axes(spark):
    square = [("o", x, y) for x in (-1.0, 1.0) for y in (-1.0, 1.0)]
    tall = [("t", x, 3 * y) for x in (-1.0, 1.0) for y in (-1.0, 1.0)]
    got = by_group(group_ellipse(spark.createDataFrame(square + tall, "g string, x double, y double"), "g", "x", "y"))
    assert got["o"]["width"] == got["o"]["height"]
    assert got["t"]["angle"] == 90.0


def test_ordinals_follow_the_first_row_and_cycle(spark):
    rows = [(i, f"g{(i * 7) % 15:02d}") for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "row_id long, g string").orderBy(F.rand(1)).repartition(5)
    got = group_ordinals(df, "g", "row_id").orderBy("ordinal").collect()
    order = list(dict.fromkeys(g for _, g in rows if g))
    assert [r["g"] for r in got] == order
    assert [r["colour"] for r in got] == [i % 12 for i in range(15)]


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_row_numbers_by_ranges(spark, ranges):
    rng = random.Random(ranges)
    values = rng.sample(range(-(2**60), 2**60), 500) + list(range(300)) + [2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v, str(v)) for v in values], "v long, n string").repartition(6)
    got = {r["v"]: (r["at"], r["n"]) for r in row_numbers(df, "v", "at", ranges).collect()}
    assert got == {v: (i, str(v)) for i, v in enumerate(sorted(values))}


def test_row_numbers_of_nothing_of_one_and_of_null(spark):
    df = spark.createDataFrame([(5,)], "v int")
    assert row_numbers(df, "v", "at").collect()[0]["at"] == 0
    assert row_numbers(df.limit(0), "v", "at").collect() == []
    with pytest.raises(ValueError, match="nulls"):
        row_numbers(spark.createDataFrame([(1,), (None,)], "v int"), "v", "at")


def test_ordinals_of_many_groups_have_no_single_window(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_orderkey", "l_partkey * 100000000 + l_orderkey * 10 + l_linenumber AS place"
    )
    ranked = group_ordinals(rows, "l_orderkey", "place")
    assert "SinglePartition" not in plan_text(ranked)
    few = group_ordinals(rows, "l_orderkey", "place", few_groups=True)
    assert "SinglePartition" in plan_text(few)
    assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, few.collect()))

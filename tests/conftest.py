import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mixscore_checks.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="4", memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def part_measurements(spark, sf_dir):
    from mixscore_checks.views import measurements

    return measurements(spark, sf_dir)


@pytest.fixture(scope="session")
def part_model(part_measurements):
    from mixscore.plans import fit_profile_pca

    return fit_profile_pca(part_measurements)


def measurement_frame(spark, solvents):
    """A measurement table with the given solvent texts, in row order."""
    from mixscore.sources.measurements import MEASUREMENT_SCHEMA

    rows = [(i, f"s{i}", s, 1.0 * i, 300.0 + i, 400.0 + i, 2.0, 100.0) for i, s in enumerate(solvents)]
    return spark.createDataFrame(rows, MEASUREMENT_SCHEMA)


def plan_text(df):
    """The physical plan before adaptive execution, as text."""
    return df._jdf.queryExecution().executedPlan().toString()

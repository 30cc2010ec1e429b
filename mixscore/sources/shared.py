"""Tables of bounded size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def small_frame(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A table of bounded size (dictionary keys, features, components).

    Built through Arrow it is a local relation: no Python worker, exact size
    statistics and constant folding.
    """
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return spark.createDataFrame(
        pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    )

"""Row and column counts of named tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shape_report(tables: dict[str, DataFrame]) -> DataFrame:
    """``(name, n_rows, n_columns)`` per table; counting reads no column."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, counts)

"""Ranks over a whole table without gathering it: ranges, their counts, ranks within.

A window without partitions sorts everything in one task. Here the ordering
column's quantiles cut it into ranges, as many as shuffle partitions; rows are counted
per range, and a row's rank is what lies in the ranges before plus its rank in its
own. Only the cuts and counts reach the driver. The cuts are part of the plan, so a lost task
computes the same ranges again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixscore.functions.text import quoted

# Accuracy of the quantiles: ranges differ from equal ones by about 1 / this of all rows.
_ACCURACY = 10_000


def _range_of(value: str, cuts: list[int]) -> str:
    """SQL text of the number of cuts that don't exceed the value, by halving."""
    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"IF({value} < {cuts[middle]}L, {tree(low, middle)}, {tree(middle + 1, high)})"

    return tree(0, len(cuts))


def row_numbers(df: DataFrame, order: str, name: str, ranges: int | None = None) -> DataFrame:
    """Append the row number, from 0, in ascending order of a column of whole numbers.

    Every row needs a value of its own: equal ones are numbered in any order,
    within one range however many they are, and nulls are an error. ``ranges`` defaults
    to the number of shuffle partitions. ``df`` is read three times; persist it if that is dear.
    """
    value = f"CAST({quoted(order)} AS BIGINT)"
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = ", ".join(repr(i / ranges) for i in range(1, max(2, ranges)))
    found, nulls = df.select(
        F.expr(f"percentile_approx({value}, array({shares}), {_ACCURACY})"), F.expr(f"count_if({value} IS NULL)")
    ).first()
    if nulls:
        raise ValueError(f"column {order!r} holds nulls")
    cuts = sorted(set(found or []))
    part, before = "__rank_range", "__rank_before"
    dealt = df.withColumn(part, F.expr(_range_of(value, cuts)))
    counts = {r[part]: r["count"] for r in dealt.groupBy(part).count().collect()}  # one row for each range
    total, firsts = 0, []
    for i in range(len(cuts) + 1):
        firsts.append(total)
        total += counts.get(i, 0)
    within = F.row_number().over(Window.partitionBy(part).orderBy(F.expr(value))) - 1
    offset = F.expr("get(array(" + ", ".join(f"{n}L" for n in firsts) + f"), {part})")
    return (
        dealt.withColumn(before, offset).withColumn(name, within + F.col(before)).drop(part, before)
    )

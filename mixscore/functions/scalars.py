"""Small column expressions used by the summary tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_weight(weight: Column, floor: float = 0.1) -> Column:
    """Weight raised to the floor."""
    return F.greatest(weight, F.lit(floor))


def with_default(mapping: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a small mapping, or the key itself."""
    if not mapping:
        return key
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[key], key)


def component_name(component: Column) -> Column:
    """``'PC1'`` for component 1, and so on."""
    return F.concat(F.lit("PC"), component.cast("string"))


def vector_norm(x: Column, y: Column) -> Column:
    """Length of the vector ``(x, y)``."""
    return F.hypot(x, y)


def fixed_text(value: Column, decimals: int) -> Column:
    """Number as text with a fixed number of decimals.

    ``format_number`` with a pattern rounds the exact binary value half to
    even; ``format_string`` would round the shortest decimal half up.
    """
    return F.call_function("format_number", value, F.lit("0." + "0" * decimals))

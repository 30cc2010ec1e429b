"""Pieces of SQL text for expressions as wide as the feature list.

A wide expression is one parsed text instead of hundreds of column objects,
each of which costs a round trip to the JVM.
"""

from __future__ import annotations


def quoted(name: str) -> str:
    """A column name, quoted."""
    return "`" + name.replace("`", "``") + "`"


def string(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float | None) -> str:
    """A double literal; ``None`` is null."""
    return "CAST(NULL AS DOUBLE)" if value is None else f"({float(value)!r}D)"


def numbers(values) -> str:
    """An array literal of doubles."""
    return "array(" + ", ".join(number(v) for v in values) + ")"


def present(value: str) -> str:
    """The value as a double with NaN turned into null."""
    return f"nanvl(CAST({value} AS DOUBLE), CAST(NULL AS DOUBLE))"

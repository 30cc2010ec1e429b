"""Scoring a stream of new measurements against a fitted analysis.

Lookup, profile and projection are row-local expressions, so the stream needs
no state, no watermark and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from mixscore.plans.model import ProfileModel, score_rows


def score_stream(stream: DataFrame, model: ProfileModel) -> DataFrame:
    """Label and PC1..PC3 for every row of a streaming measurement table."""
    if not stream.isStreaming:
        raise ValueError("score_stream expects a streaming DataFrame; use score_rows for a batch")
    return score_rows(stream, model)

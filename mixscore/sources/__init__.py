from mixscore.sources.dictionary import (
    DISPLAY_LABELS,
    FEATURES,
    INITIAL_WEIGHTS,
    SOLVENTS,
    PropertyDictionary,
    labels_frame,
    weights_frame,
)
from mixscore.sources.measurements import (
    MEASUREMENT_SCHEMA,
    require_columns,
    scan_measurements,
    with_row_id,
)
from mixscore.sources.shared import small_frame

__all__ = [
    "DISPLAY_LABELS",
    "FEATURES",
    "INITIAL_WEIGHTS",
    "MEASUREMENT_SCHEMA",
    "PropertyDictionary",
    "SOLVENTS",
    "labels_frame",
    "require_columns",
    "scan_measurements",
    "small_frame",
    "weights_frame",
    "with_row_id",
]

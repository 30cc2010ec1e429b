from mixscore.functions.lookup import (
    first_match,
    label_of,
    mixture_hits,
    mixture_profile,
    normalise_key,
    with_main_label,
)
from mixscore.functions.scalars import (
    component_name,
    fixed_text,
    floor_weight,
    vector_norm,
    with_default,
)

__all__ = [
    "component_name",
    "first_match",
    "fixed_text",
    "floor_weight",
    "label_of",
    "mixture_hits",
    "mixture_profile",
    "normalise_key",
    "vector_norm",
    "with_default",
    "with_main_label",
]

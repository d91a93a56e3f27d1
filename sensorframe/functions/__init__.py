from sensorframe.functions.frames import centred_bounds, trailing_bounds
from sensorframe.functions.scalar import (
    clip_negative,
    guarded_ratio,
    missing_text_to_null,
    nan_to_null,
    residual,
    round_half_even,
    strict_number,
    to_number,
)

__all__ = [
    "centred_bounds",
    "clip_negative",
    "guarded_ratio",
    "missing_text_to_null",
    "nan_to_null",
    "residual",
    "round_half_even",
    "strict_number",
    "to_number",
    "trailing_bounds",
]

from recurra.functions.dates import add_years, average_months, parse_day
from recurra.functions.labels import (
    band,
    band_order,
    level_label,
    level_order,
    percent_label,
    with_automatic_labels,
)

__all__ = [
    "add_years",
    "average_months",
    "band",
    "band_order",
    "level_label",
    "level_order",
    "parse_day",
    "percent_label",
    "with_automatic_labels",
]

from recurra.plans.prepared import (
    classify_prepared,
    prepare_attribute,
    prepare_cohort,
    prepared_mix,
    prepared_rates,
    prepared_rates_by_duration,
    prepared_schema,
)
from recurra.plans.reports import ReturnStudy

__all__ = [
    "ReturnStudy",
    "classify_prepared",
    "prepare_attribute",
    "prepare_cohort",
    "prepared_mix",
    "prepared_rates",
    "prepared_rates_by_duration",
    "prepared_schema",
]

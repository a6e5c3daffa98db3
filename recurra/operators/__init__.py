from recurra.operators.attributes import (
    add_distinct_values,
    add_entity_attribute,
    add_episode_attribute,
    consistent_attribute,
    consistent_records,
    distinct_values,
    first_records,
)
from recurra.operators.clean import (
    clean_episodes,
    columns_first,
    parse_date_columns,
    rejected_episodes,
    valid_episodes,
)
from recurra.operators.cohort import add_horizons, build_cohort, cohort_episodes
from recurra.operators.ids import add_case_ids, number_keys
from recurra.operators.mix import category_counts, category_shares
from recurra.operators.reduce import with_keys_of
from recurra.operators.reshape import (
    chart_table,
    columns_between,
    columns_with_prefix,
    in_report_order,
    in_row_order,
    order_levels,
    rates_long,
)
from recurra.operators.returns import classify_return, return_flags, return_rates
from recurra.operators.skew import join_per_key
from recurra.operators.state import cohort_of_state, entity_state, flags_of_state, merge_states

__all__ = [
    "add_case_ids",
    "add_distinct_values",
    "add_entity_attribute",
    "add_episode_attribute",
    "add_horizons",
    "build_cohort",
    "category_counts",
    "category_shares",
    "chart_table",
    "classify_return",
    "clean_episodes",
    "cohort_episodes",
    "cohort_of_state",
    "columns_between",
    "columns_first",
    "columns_with_prefix",
    "consistent_attribute",
    "consistent_records",
    "distinct_values",
    "entity_state",
    "first_records",
    "flags_of_state",
    "in_report_order",
    "in_row_order",
    "join_per_key",
    "merge_states",
    "number_keys",
    "order_levels",
    "parse_date_columns",
    "rates_long",
    "rejected_episodes",
    "return_flags",
    "return_rates",
    "valid_episodes",
    "with_keys_of",
]

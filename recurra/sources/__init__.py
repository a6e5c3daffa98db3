from recurra.sources.buckets import read_bucketed, write_bucketed
from recurra.sources.tables import (
    attribute_schema,
    read_attribute_file,
    read_episode_files,
    read_rejects,
    read_table,
    reject_counts,
    write_table,
)
from recurra.sources.years import read_years, replace_years, write_years

__all__ = [
    "attribute_schema",
    "read_attribute_file",
    "read_bucketed",
    "read_episode_files",
    "read_rejects",
    "read_table",
    "read_years",
    "reject_counts",
    "replace_years",
    "write_bucketed",
    "write_table",
    "write_years",
]

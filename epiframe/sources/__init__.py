"""Readers and writers."""

from epiframe.sources.files import (
    read_enriched, read_mapping, read_panel, read_population, read_table, write_csv,
)
from epiframe.sources.records import parse_record_array, parse_records, to_records

__all__ = [
    "read_table", "read_panel", "read_population", "read_mapping", "read_enriched",
    "write_csv", "to_records", "parse_records", "parse_record_array",
]

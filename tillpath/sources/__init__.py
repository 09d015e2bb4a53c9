"""Readers and writers for the event and item tables."""

from tillpath.sources.csv_files import read_csv_table, write_csv_table
from tillpath.sources.derived import raw_events, raw_items
from tillpath.sources.rejects import accepted, at_most, land_csv_judged, read_csv_judged, reject_counts
from tillpath.sources.store import (
    BATCH_FOLDER,
    MONTH_FOLDER,
    read_bucketed,
    read_table,
    scratch_path,
    shared_folder,
    table_exists,
    write_bucketed,
    write_master,
    write_table,
)

__all__ = [
    "BATCH_FOLDER",
    "MONTH_FOLDER",
    "accepted",
    "at_most",
    "land_csv_judged",
    "raw_events",
    "raw_items",
    "read_csv_judged",
    "read_csv_table",
    "read_bucketed",
    "read_table",
    "reject_counts",
    "scratch_path",
    "shared_folder",
    "table_exists",
    "write_bucketed",
    "write_csv_table",
    "write_master",
    "write_table",
]

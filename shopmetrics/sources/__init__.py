"""Readers, writers and the driver-table fixtures."""

from .export import read_segment, report_path, write_report, write_segments
from .order_store import default_range_of_store, open_order_store, statistics_session, write_order_store
from .publish import drop_old_runs, parameters_key, publish, published, read_published
from .readers import (
    file_position,
    header_catalogue,
    load_tables,
    read_csv_table,
    read_csv_with_misfits,
    read_sheets,
    read_table,
    read_text_sheet,
    table_name,
    typed_by_value,
    union_sheets,
    value_types,
)

__all__ = [
    "default_range_of_store",
    "drop_old_runs",
    "file_position",
    "header_catalogue",
    "load_tables",
    "open_order_store",
    "parameters_key",
    "publish",
    "published",
    "read_csv_table",
    "read_csv_with_misfits",
    "read_published",
    "read_segment",
    "read_sheets",
    "read_table",
    "read_text_sheet",
    "report_path",
    "statistics_session",
    "table_name",
    "typed_by_value",
    "union_sheets",
    "value_types",
    "write_order_store",
    "write_report",
    "write_segments",
]

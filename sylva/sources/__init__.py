"""Sources and sinks: parquet views, staged tables, one-hot CSV ingest, CSV export."""

from .parquet import (TABLES, class_counts, load_views, read_table, register, require_rows, stage, staged,
                      view_counts, write_read_parquet)

__all__ = ["TABLES", "class_counts", "load_views", "read_table", "register", "require_rows", "stage", "staged",
           "view_counts", "write_read_parquet"]

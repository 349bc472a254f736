"""Readers and writers."""

from .arrow import from_arrow, from_columns, from_records, read_ipc, scan_batches, write_ipc
from .database import read_dbapi, read_jdbc, write_dbapi, write_jdbc
from .files import read_csv, read_csv_async, read_json, read_ndjson, read_parquet, read_parquet_async, write_csv, write_json, write_ndjson, write_parquet
from .sinks import export_batches, sink_batches

__all__ = ["export_batches", "from_arrow", "from_columns", "from_records", "read_csv", "read_csv_async", "read_dbapi", "read_ipc", "read_jdbc", "read_json", "read_ndjson", "read_parquet", "read_parquet_async", "scan_batches", "sink_batches", "write_csv", "write_dbapi", "write_ipc", "write_jdbc", "write_json", "write_ndjson", "write_parquet"]

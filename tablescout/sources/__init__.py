from tablescout.sources.readers import (
    head, load, load_directory, load_owner_tables, page, read_csv, read_json, read_parquet, sample_rows,
)
from tablescout.sources.sinks import read_stored, replace_table, table_name, write_table
from tablescout.sources.validate import validate_table

__all__ = ["head", "load", "load_directory", "load_owner_tables", "page", "read_csv", "read_json", "read_parquet",
           "read_stored", "replace_table", "sample_rows", "table_name", "validate_table", "write_table"]

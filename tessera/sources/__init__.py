"""Scans and sinks: parquet test tables, the retail view, CSV, synthetic shapes."""

from tessera.sources.tables import TABLES, load, load_all, retail_view  # noqa: F401
from tessera.sources.csv import scan_csv, standardise_columns, write_csv  # noqa: F401

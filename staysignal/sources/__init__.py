"""Sources and sinks: the given parquet tables, the derived customer view,
CSV / JDBC / file-listing readers and the table writers."""

from .tables import read_table, TABLES
from .customer_view import raw_customers

__all__ = ["read_table", "TABLES", "raw_customers"]

"""Schema'd readers and writers."""

from .tables import TABLES, load, read_text_table, register_views, write_bucketed, write_table

__all__ = ["TABLES", "load", "read_text_table", "register_views", "write_bucketed", "write_table"]

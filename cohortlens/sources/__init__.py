"""Readers, writers and the reference-shaped views over the shared tables."""
from .tables import Tables, read_table, write_table, read_csv, write_csv  # noqa: F401

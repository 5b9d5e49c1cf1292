"""Raw tables: JSON lines, CSV, Parquet or a named table."""

from covenant.sources.readers import read_source

__all__ = ["read_source"]

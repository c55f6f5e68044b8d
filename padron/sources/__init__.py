"""Readers and writers: delimited files, JSON lines, Parquet, and whole lakes."""

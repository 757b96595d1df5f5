"""Readers of records, index files and snapshots, and their writers."""

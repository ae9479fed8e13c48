"""Scans: file trees, line slices, SQLite catalogs and stored tables."""

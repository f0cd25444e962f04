"""Readers and writers: landed pages, immutable runs, scope authority, report tables."""

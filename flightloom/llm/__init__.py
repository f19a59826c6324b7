"""Operators for preparing training data: search, scans, packing, scoring, deduplication and encoding."""

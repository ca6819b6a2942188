"""Operators of a training-data pipeline: packing, filters, mixing, search, near duplicates, scans and token files."""

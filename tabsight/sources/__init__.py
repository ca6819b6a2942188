"""Scans, file audit, row numbering and sinks."""

"""Batch sources of records: framed files, packet captures, generated traffic."""

"""Incremental appends as streams."""

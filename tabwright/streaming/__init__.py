"""Ingest of files that keep arriving."""

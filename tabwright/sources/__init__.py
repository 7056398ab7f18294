"""Readers and writers of delimited files."""

"""Readers and writers: history files, listings, tables, ingest batches."""

"""Bulk ingest of log formats: lines, elements or documents in, records, diagnostics and counts out."""

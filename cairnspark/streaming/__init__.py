"""Streaming of the report-analytics engine."""

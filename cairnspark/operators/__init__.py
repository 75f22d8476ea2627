"""Operators of the report-analytics engine."""

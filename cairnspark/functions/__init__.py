"""Functions of the report-analytics engine."""

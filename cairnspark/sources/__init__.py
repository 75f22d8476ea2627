"""Sources of the report-analytics engine."""

"""Plans of the report-analytics engine."""

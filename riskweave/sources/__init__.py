"""Sources and sinks: loan CSV/Parquet, macro tables, fixtures, exports."""

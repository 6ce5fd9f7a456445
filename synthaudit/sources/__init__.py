"""Sources and sinks: parquet tables, CSV with inference, JSON results."""

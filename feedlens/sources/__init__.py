"""Sources and sinks: file readers, the Parquet signal store and its registry."""

"""Sources and sinks: text/XML/parquet readers, writers, materialisation, test-table views."""

"""Sources and sinks: typed CSV ingest with null-token discipline, polygon
layers, the binding of the domain onto the driver's parquet tables, and
materialisation helpers."""

"""Incremental ingest.

The analyses are batch: every statistic is over complete event windows. What
arrives over time is new analyte files; ``ingest`` turns a folder of them into
an append-only typed Parquet table with Structured Streaming (file source,
exactly-once file sink, checkpointed progress), so batch stages can re-read a
table that grows without re-parsing old files.
"""

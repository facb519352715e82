"""Streams: sentences and fragments built as text comes in, event logs, progress, incremental indexing."""

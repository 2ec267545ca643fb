"""Incremental and stateful ingestion."""

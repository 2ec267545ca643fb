"""Catalogue operators: identity, snapshots, search, enrichment and assets."""

"""Feed readers, the export sink and run records."""

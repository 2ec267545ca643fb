"""Training-data operators: licence scans, dedup, quality, chat, URLs, tokens and packing."""

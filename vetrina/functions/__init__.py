"""Column functions for text, prices, sizes and identifiers."""

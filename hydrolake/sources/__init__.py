"""Reading and writing monitoring tables."""

"""Reading and writing log tables."""

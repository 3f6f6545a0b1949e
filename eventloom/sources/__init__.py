"""Reading and writing event data."""

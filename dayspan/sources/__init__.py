"""Reading and writing named tables."""

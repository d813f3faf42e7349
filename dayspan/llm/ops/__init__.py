"""The thin queries: table, operator, result columns."""

"""Queries over the given tables, by theme; each has the key of its operator in the inventory."""

"""Thin queries: each applies one operator to its whole table."""

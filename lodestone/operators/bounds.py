"""Sizes up to which one side of an operation is held by every task; beyond them it is dealt into blocks."""

#: Query vectors of a batch that goes to every task as a matrix.
MOST_ROWS = 10_000

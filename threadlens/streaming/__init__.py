"""Incremental forms of the algebraic aggregates."""

"""Operators: ``DataFrame -> DataFrame``, for use with ``df.transform``."""

"""Operators for preparing texts as training data.  Nothing outside this package imports it."""

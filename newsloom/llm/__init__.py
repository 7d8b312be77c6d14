"""Operators for the preparation of training text.  Nothing outside this package imports it."""

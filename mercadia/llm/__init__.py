"""Operators for preparing training text: quality, duplicates, leaks, tokens, packing.

Nothing else in the library imports this subpackage.
"""

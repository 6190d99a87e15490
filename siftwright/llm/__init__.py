"""Operators for large training corpora: filters, near-duplicates, mixing, rendering.

Nothing else in the library imports this subpackage.
"""

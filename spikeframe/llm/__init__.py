"""Operators for preparing training data: deduplication, scoring, filtering, mixing and encoding of text.

Nothing outside this subpackage imports it.
"""

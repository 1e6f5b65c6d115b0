"""Operators for preparing training data: scoring, packing, mixing, formatting, counting, deduplication.

Nothing else in the library imports this subpackage.
"""

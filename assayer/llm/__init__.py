"""Operators for preparing training data: deduplication, search, extraction, scoring, mixing and formatting.

Nothing else in the library imports this package.  Functions that run in Python
workers are shipped by value, so executors need only the public libraries.
"""

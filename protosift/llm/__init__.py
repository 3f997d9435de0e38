"""Operators for preparing training text: deduplication, scans, scoring, encoding.

Each module is one operator with its own interface; ``queries`` registers them
on the provided tables. Nothing else in the library imports this subpackage.
"""

"""Operators for preparing training text: filtering, near-duplicates, encoding, archives.

Nothing outside this package imports it. Every operator takes and returns
DataFrames, reads whole texts, and keeps rows with null columns.
"""

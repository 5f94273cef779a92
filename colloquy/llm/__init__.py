"""Operators for preparing training text: mixing, deduplication, cleaning, scoring, archives.

Nothing outside this package imports it. `catalog.py` holds the queries and their SQL.
"""

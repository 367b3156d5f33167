"""Operators for preparing text corpora, and the queries that run them.

Nothing else in the library imports this package.
"""

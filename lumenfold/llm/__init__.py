"""Corpus operators for training data: packing, deduplication, filtering, sharding, search.

Nothing else in the library imports this subpackage; ``registry`` holds its queries and SQL.
"""

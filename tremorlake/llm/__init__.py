"""Operators for training-data pipelines: packing, counting, filtering, dedup, search, output.

Nothing else in the library imports this package.
"""

"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; `queries.py` holds the registered
queries and their SQL, every other module one operator with its own interface.
"""

"""Operators for building training corpora, and the queries that apply them.

Nothing else in the library imports this subpackage. ``registry`` lists the
queries (``op1_...`` to ``op10_...`` and ``pipeline``) with their SQL.
"""

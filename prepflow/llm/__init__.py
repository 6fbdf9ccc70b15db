"""Operators of a training-data pipeline over documents, pages and conversations.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when the package is present.
"""

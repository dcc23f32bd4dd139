"""Operators of a training-data pipeline over documents, pages, conversations and embeddings.

Nothing else in the package imports this subpackage.
"""

"""Operators for training-data pipelines over the documents and embeddings tables.

Nothing else in the package imports this one; deleting the folder leaves the rest working.
"""

"""Operators for building training corpora from documents, pages and embeddings.

Nothing else in the library imports this subpackage; `queries` registers the
operators for the driver.
"""

"""Operators of a training-data pipeline over the documents, pages and conversations tables."""

"""Operators of a training-data pipeline over corpora of documents, pages and vectors."""

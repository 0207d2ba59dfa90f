"""Readers of documents, and stores for what is indexed."""

"""Hybrid document search and data processing as Spark DataFrame plans."""

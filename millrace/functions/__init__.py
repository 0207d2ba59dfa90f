"""Scalar functions: columns over text and vectors, and what runs once on a query string."""

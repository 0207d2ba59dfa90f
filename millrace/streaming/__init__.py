"""Structured Streaming into the engine."""

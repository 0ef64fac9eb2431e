"""Structured Streaming into collections."""

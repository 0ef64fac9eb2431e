"""Operators on record tables."""

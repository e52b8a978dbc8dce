"""Operators over token and document tables."""

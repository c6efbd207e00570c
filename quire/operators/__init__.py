"""Relational operators over corpus tables."""

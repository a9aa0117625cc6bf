"""Relational operators over production tables."""

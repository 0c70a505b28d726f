"""Operators on catalogs, scores and lists."""

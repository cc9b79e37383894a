"""Whole workflows built from the operators, and the query catalogue."""

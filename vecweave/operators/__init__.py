"""Operators over graphs, similarities, vertex sets and run records."""

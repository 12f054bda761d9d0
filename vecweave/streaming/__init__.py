"""Graphs from event streams."""

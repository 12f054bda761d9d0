"""Readers and writers of graphs, vectors, vertex sets, labels and run records."""

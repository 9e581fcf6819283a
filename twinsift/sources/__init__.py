"""Readers and writers for questions, pairs, labels, vectors, clusters and notes."""

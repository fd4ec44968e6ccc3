"""Readers, writers, versioned tables and the inputs derived from the given tables."""

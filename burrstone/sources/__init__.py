"""Readers, writers and generators of tuples and edges."""

"""Readers, writers and the test views over the given tables."""

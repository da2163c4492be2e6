"""Readers, writers, marks and the index table."""

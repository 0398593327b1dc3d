"""Readers, writers and the views over the sample tables."""

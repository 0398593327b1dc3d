"""Composite analyses: named result tables of one commit table."""

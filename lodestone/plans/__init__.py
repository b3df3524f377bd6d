"""Queries over the supplied tables, and their SQL."""

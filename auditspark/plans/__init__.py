"""Stages put together: whole audits, and the queries over the given tables."""

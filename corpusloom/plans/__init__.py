"""Composed jobs, derived views and the query registry."""

"""Whole pipelines: synchronisation and recommendation."""

"""Semantic matchmaking over tables and streams, on PySpark."""

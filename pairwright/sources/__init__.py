"""JSON payload sources and versioned Parquet tables."""

"""Change feeds kept up with by Structured Streaming."""

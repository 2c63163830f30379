"""DataFrame operators: validation, embedding, keyed changes, search, lookup, metrics."""

"""Training-data pipeline operators: search, deduplication, tokens, quality, mixing, archives."""

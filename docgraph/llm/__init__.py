"""Training-data operators: quality, deduplication, mixing, formatting, tokens, shards."""

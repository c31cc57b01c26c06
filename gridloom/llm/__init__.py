"""Training-data pipeline operators: filtering, deduplication, mixing, search, tokenising."""

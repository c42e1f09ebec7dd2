"""Training-data operators: cleaning, deduplication, search, scoring, formatting."""

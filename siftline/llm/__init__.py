"""Training-data operators: filtering, formatting, scoring, deduplication, mixing and packing."""

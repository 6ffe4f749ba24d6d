"""Training-data operators: tokenising, filtering, deduplication, packing, archives, search and chat formatting."""

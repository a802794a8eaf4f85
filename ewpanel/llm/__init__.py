"""Training-data operators: search, deduplication, mixing, packing and file formats."""

"""Training-data operators: packing, extraction, filtering, near-duplicate search and archives."""

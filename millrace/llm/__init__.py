"""Training-data operators: scans, scoring, dedup, packing, archives, search."""

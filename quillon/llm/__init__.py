"""Training-data operators: near duplicates, scoring, extraction, packing, sharding."""

"""Training-data operators: packing, dedup, language ID, toxicity, sharding, search, tokens."""

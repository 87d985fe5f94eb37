"""Training-data operators: sharding, language ID, secrets, dedup, tokenising and their kin."""

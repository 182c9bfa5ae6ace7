"""Training-data operators: language ID, mixing, tokenisation, near-duplicates, search."""

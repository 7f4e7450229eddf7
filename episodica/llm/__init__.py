"""Training-data operators: search, classify, extract, deduplicate, decontaminate, encode and pack."""

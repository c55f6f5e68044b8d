"""Training-data operators: cleaning, deduplication, scoring and encoding of documents."""

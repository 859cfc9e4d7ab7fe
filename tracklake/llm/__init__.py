"""Training-data operators: deduplication, filters, tokenizers, packing, sharding, PII."""

"""Training-data operators: filters, deduplication, tokens, packing, shards and media."""

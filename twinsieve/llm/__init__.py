"""Training-data operators: filters, scoring, deduplication, mixing, sharding and packing."""

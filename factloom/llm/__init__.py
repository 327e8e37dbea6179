"""Training-data operators over a table of documents (packing, deduplication, scoring, sharding)."""

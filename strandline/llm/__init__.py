"""Operators for preparing text corpora at scale: mixing, dedup, packing, sharding, search, counting, encoding, scoring."""

"""Operators for building training corpora: language, duplicates, secrets, packing, shards."""

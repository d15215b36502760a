"""Operators for large training-data corpora: search, near-duplicates, packing, mixing, media, language, lines, shards, LM scores, quality."""

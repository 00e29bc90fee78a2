"""Operators for preparing training data: filtering, deduplication, search, encoding, packing."""

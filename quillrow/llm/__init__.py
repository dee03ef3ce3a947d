"""Operators for large text corpora: mixing, search, deduplication, scanning, tokens."""

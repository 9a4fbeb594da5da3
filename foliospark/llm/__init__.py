"""Corpus operators for training data: deduplication, filters, mixing, tokens, archives."""

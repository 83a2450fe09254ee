"""Operators for training data: deduplication, packing, tokens, and filters over documents, pages and embeddings."""

"""Operators for training-data corpora: documents in, decisions, scores, shards or token files out."""

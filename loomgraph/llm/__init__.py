"""Operators for training data: overlap across splits, entity resolution, nearest vectors, packing, leakage, subjects."""

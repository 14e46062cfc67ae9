"""Operators for training-data pipelines: language, leakage, tokens, mixtures, duplicates, quality, packing, privacy."""

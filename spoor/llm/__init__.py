"""Operators of a training-data pipeline: search, classifiers, deduplication, tokens, packing, fingerprints."""

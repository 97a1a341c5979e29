"""Operators of a training-data pipeline: shards, tokens, filters, search, packing."""

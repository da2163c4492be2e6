"""Operators of a training-data pipeline: filters, near duplicates, search, mixing, tokens, formatting, sharding."""

"""Operators of a training-data pipeline: search, dedup, archives, formatting, rules, tokens, packing."""

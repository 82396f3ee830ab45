"""Operators of a training-data pipeline: search, classification, redaction, deduplication, mixing, tokens."""

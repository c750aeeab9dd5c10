"""Operators of a training-data pipeline: cleaning, extraction, mixing, deduplication, scoring."""

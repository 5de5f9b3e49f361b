"""Operators of a training-data pipeline: extraction, filtering, near
duplicates, mixing, formatting, tokenisation, scoring and search."""

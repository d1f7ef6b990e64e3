"""Operators of a training-data pipeline: tokens, extraction, near-copies, quality, leakage, token files."""

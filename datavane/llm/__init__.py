"""Operators for large text corpora that feed model training."""

"""Relational operators: sequences, features, splits, thresholds, metrics and models."""

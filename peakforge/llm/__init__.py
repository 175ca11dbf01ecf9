"""Operators for preparing training data: clusters, grouped splits, canonical values, vector search, leaks, mixing, cut texts."""

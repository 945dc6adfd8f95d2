"""Operators for text corpora that become training data. Nothing outside this package imports it."""

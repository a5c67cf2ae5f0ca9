"""Operators for large text corpora: cleaning, de-duplication, filtering and packing of training data."""

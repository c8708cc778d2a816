"""Operators for training data: sketches over huge columns, tokens, packing and page quality."""

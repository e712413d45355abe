"""Operators for training-data corpora: one module each, nothing else in the library imports them."""

"""Operators for text corpora at training-data scale; nothing else in the package imports them."""

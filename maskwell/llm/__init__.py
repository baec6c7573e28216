"""Operators that prepare text for training and evaluation corpora."""

"""Operators for training data made of text and code. Nothing outside this package imports it."""

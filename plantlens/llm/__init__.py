"""Operators for preparing text to train language models on; nothing else in the library imports this package."""

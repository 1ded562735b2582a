"""Operators for text corpora used to train language models; nothing else in the library imports them."""

"""Operators for training data; nothing outside this folder imports them."""

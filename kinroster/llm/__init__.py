"""Operators that prepare text for training large models; nothing else in the library imports them."""

"""Operators that prepare text collections for training language models.

Nothing else in the library imports this package; it can be removed as a whole.
"""

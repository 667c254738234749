"""Operators for training data.  Optional: nothing else in the library imports this package."""

"""Operators for building language-model training data. Nothing else in this library imports this package."""

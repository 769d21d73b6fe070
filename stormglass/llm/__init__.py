"""Operators for preparing training data from post streams and documents."""

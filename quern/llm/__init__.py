"""Operators on text and vectors for training data. Nothing outside this subpackage imports it."""

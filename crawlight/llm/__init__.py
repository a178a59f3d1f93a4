"""Operators for building language-model training data from large text tables."""

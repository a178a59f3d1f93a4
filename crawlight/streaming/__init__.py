"""Continuous audit over event streams."""

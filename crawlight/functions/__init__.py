"""Column functions: URLs, text, prices."""

"""From findings to reports."""

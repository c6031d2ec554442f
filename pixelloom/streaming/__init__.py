"""Filters over image files as they arrive."""

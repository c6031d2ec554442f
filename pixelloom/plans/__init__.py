"""Filter plans and their rewrites."""
